"""Comparison, boolean, conditional and variable operators."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .core import BOOL, LONG, REMOVE, E, Scope, array, arguments, cast, common_type, compile_expression, equal, less, literal, named, register, truthy, value


def _compare(name: str, test) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        if isinstance(spec, list) and len(spec) == 2:
            return E(test(*arguments(spec, scope, name, 2, 2)), BOOL, certain=True)
        raise QueryError(f"{name} takes two arguments")


_compare("$eq", equal)
_compare("$ne", lambda a, b: ~equal(a, b))
_compare("$gt", lambda a, b: less(b, a))
_compare("$gte", lambda a, b: ~less(a, b))
_compare("$lt", less)
_compare("$lte", lambda a, b: ~less(b, a))


@register("$cmp")
def cmp(spec: Any, scope: Scope) -> E:
    a, b = arguments(spec, scope, "$cmp", 2, 2)
    return E(F.when(less(a, b), F.lit(-1)).when(less(b, a), F.lit(1)).otherwise(F.lit(0)).cast(LONG), LONG)


@register("$and")
def and_(spec: Any, scope: Scope) -> E:
    return E(reduce(lambda a, b: a & b, [truthy(e) for e in arguments(spec, scope, "$and", 0)] or [F.lit(True)]), BOOL, certain=True)


@register("$or")
def or_(spec: Any, scope: Scope) -> E:
    return E(reduce(lambda a, b: a | b, [truthy(e) for e in arguments(spec, scope, "$or", 0)] or [F.lit(False)]), BOOL, certain=True)


@register("$in")
def in_(spec: Any, scope: Scope) -> E:
    needle, items = arguments(spec, scope, "$in", 2, 2)
    items = array(items, "$in")
    return E(F.when(items.col.isNotNull(), F.exists(items.col, lambda x: equal(E(x, items.type.elementType), needle))), BOOL)


def _field_form(name: str) -> None:
    @register(name)
    def handler(spec: Any, scope: Scope) -> E:
        from ..operators.filters import field_condition

        if not (isinstance(spec, list) and len(spec) == 2 and isinstance(spec[0], str) and spec[0].startswith("$")):
            raise QueryError(f"{name} takes a field path and an operand in an expression")
        return E(field_condition(value(spec[0], scope), name, spec[1], scope), BOOL)


for _name in ("$nin", "$all", "$exists", "$elemMatch"):
    _field_form(_name)


@register("$ifNull")
def if_null(spec: Any, scope: Scope) -> E:
    args = arguments(spec, scope, "$ifNull", 2)
    kind = common_type([e.type for e in args])
    return E(F.coalesce(*[cast(e, kind) for e in args]), kind)


def _choice(branches: list[tuple[Any, Any]], default: Any, scope: Scope, complete: bool = True):
    conditions = [truthy(value(c, scope)) for c, _ in branches]
    made = [compile_expression(v, scope) for _, v in branches] + ([compile_expression(default, scope)] if complete else [])
    if all(e is REMOVE for e in made):
        return REMOVE
    # where a branch removes its field the typed column holds null, which is the same
    results = [literal(None) if e is REMOVE else e for e in made]
    kind = common_type([e.type for e in results])
    last = cast(results[-1], kind) if complete else F.raise_error(F.lit("$switch found no branch and has no default"))
    chain = F
    for condition, result in zip(conditions, results, strict=False):
        chain = chain.when(condition, cast(result, kind))
    return E(chain.otherwise(last), kind)


@register("$cond")
def cond(spec: Any, scope: Scope):
    if isinstance(spec, dict):
        named(spec, "$cond", ("if", "then", "else"))
        spec = [spec["if"], spec["then"], spec["else"]]
    if not isinstance(spec, list) or len(spec) != 3:
        raise QueryError("$cond takes if, then and else")
    return _choice([(spec[0], spec[1])], spec[2], scope)


@register("$switch")
def switch(spec: Any, scope: Scope):
    named(spec, "$switch", ("branches",), ("default",))
    if not isinstance(spec["branches"], list) or not spec["branches"]:
        raise QueryError("$switch needs branches")
    branches = [(b["case"], b["then"]) for b in (named(b, "$switch branch", ("case", "then")) for b in spec["branches"])]
    return _choice(branches, spec.get("default"), scope, "default" in spec)


@register("$let")
def let(spec: Any, scope: Scope):
    named(spec, "$let", ("vars", "in"))
    return compile_expression(spec["in"], scope.bind(**{n: value(v, scope) for n, v in spec["vars"].items()}))


@register("$literal")
def literal_(spec: Any, scope: Scope) -> E:
    return literal(spec)


#: Hidden columns that carry search results' metadata, and their types.
META = {"textScore": T.DoubleType(), "vectorSearchScore": T.DoubleType(), "searchScore": T.DoubleType(), "searchHighlights": T.StringType()}


@register("$meta")
def meta(spec: Any, scope: Scope) -> E:
    if spec not in META:
        raise QueryError(f"unknown metadata {spec}")
    return scope.fields.get(f"__meta_{spec}", E(F.lit(None).cast(META[spec]), META[spec]))
