"""Expression operators, lowered to Spark columns.

Importing the package fills the registry: every module below registers its operators under their names.
"""

from . import arith, arrays, control, convert, dates, objects, strings  # noqa: F401 - registration
from .core import E, Scope, compile_expression, operators, register

__all__ = ["E", "Scope", "compile_expression", "operators", "register"]
