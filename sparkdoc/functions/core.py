"""Typed columns, scopes, paths and the expression registry.

Expressions are compiled against a schema: every sub-expression is a Column with its Spark type, so all dispatch on
types happens here and Catalyst sees plain native expressions. Null and missing coincide in typed columns.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedOperator

LONG, DOUBLE, STRING, BOOL, DATE = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()
DECIMAL = T.DecimalType(38, 18)


@dataclass(frozen=True)
class E:
    """A column and its type; `certain`: a boolean that is never null."""

    col: Column
    type: T.DataType
    certain: bool = False


class Remove:
    """`$$REMOVE`: the field that gets it is left out."""


REMOVE = Remove()


@dataclass(frozen=True)
class Scope:
    """What names mean: the fields of the current row and the variables. `order` is the ordinal column, if one is carried."""

    fields: dict[str, E]
    variables: dict[str, E] = field(default_factory=dict)
    now: datetime.datetime | None = None

    @staticmethod
    def of(schema: T.StructType, variables: dict[str, E] | None = None) -> Scope:
        return Scope({f.name: E(F.col(quote(f.name)), f.dataType) for f in schema.fields}, variables or {})

    def bind(self, **variables: E) -> Scope:
        return replace(self, variables=self.variables | variables)

    def root(self) -> E:
        shown = {n: e for n, e in self.fields.items() if not hidden(n)}
        return struct_of(shown)


#: Columns that the engine carries beside a document: order keys and search metadata.
HIDDEN = ("__sd_", "__meta_")


def hidden(name: str) -> bool:
    return name.startswith(HIDDEN)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def struct_of(fields: dict[str, E]) -> E:
    return E(F.struct(*[e.col.alias(n) for n, e in fields.items()]), T.StructType([T.StructField(n, e.type) for n, e in fields.items()]))


# --- types -----------------------------------------------------------------------------------------------------------


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def concrete_type(t: T.DataType) -> T.DataType:
    """Tables have no columns of unknown type; theirs is string."""
    return STRING if is_null(t) else t


def is_int(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, T.DoubleType | T.FloatType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, T.TimestampNTZType | T.TimestampType | T.DateType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_object(t: T.DataType) -> bool:
    return isinstance(t, T.StructType | T.MapType)


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def rank(t: T.DataType) -> int:
    """Place of a type in the order across types."""
    for place, test in ((1, is_null), (2, is_number), (3, is_string), (4, is_object), (5, is_array), (6, lambda x: isinstance(x, T.BinaryType)), (8, lambda x: isinstance(x, T.BooleanType)), (9, is_date)):
        if test(t):
            return place
    raise QueryError(f"values of type {t.simpleString()} have no order")


def alias_of(t: T.DataType) -> str:
    """The language's name of a type."""
    if isinstance(t, T.LongType):
        return "long"
    if is_int(t):
        return "int"
    if is_float(t):
        return "double"
    if isinstance(t, T.DecimalType):
        return "decimal"
    return {1: "missing", 3: "string", 4: "object", 5: "array", 6: "binData", 8: "bool", 9: "date"}[rank(t)]


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type that holds all: integers widen to long, with a double to double, with a decimal to decimal."""
    known = [t for t in types if not is_null(t)]
    if not known:
        return T.NullType()
    if all(t == known[0] for t in known):
        return known[0]
    if all(map(is_number, known)):
        if any(isinstance(t, T.DecimalType) for t in known):
            return DECIMAL
        return DOUBLE if any(map(is_float, known)) else LONG
    if all(map(is_date, known)):
        return DATE
    if all(map(is_string, known)):
        return STRING
    if all(map(is_array, known)):
        return T.ArrayType(common_type([t.elementType for t in known]))
    if all(isinstance(t, T.StructType) for t in known):
        names = list(dict.fromkeys(n for t in known for n in t.names))
        return T.StructType([T.StructField(n, common_type([t[n].dataType for t in known if n in t.names])) for n in names])
    raise QueryError("values of different kinds: " + ", ".join(sorted({t.simpleString() for t in known})))


def cast(e: E, to: T.DataType) -> Column:
    """e as `to`, struct fields matched by name."""
    if e.type == to or is_null(to):
        return e.col
    if is_null(e.type):
        return F.lit(None).cast(to)
    if isinstance(to, T.StructType) and isinstance(e.type, T.StructType):
        parts = [(cast(E(e.col.getField(f.name), e.type[f.name].dataType), f.dataType) if f.name in e.type.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(e.col.isNotNull(), F.struct(*parts))
    if is_array(to) and is_array(e.type) and isinstance(to.elementType, T.StructType):
        return F.transform(e.col, lambda x: cast(E(x, e.type.elementType), to.elementType))
    return e.col.cast(to)


def wide(e: E) -> E:
    """Integers as long, float as double."""
    if is_int(e.type) and not isinstance(e.type, T.LongType):
        return E(e.col.cast(LONG), LONG)
    if isinstance(e.type, T.FloatType):
        return E(e.col.cast(DOUBLE), DOUBLE)
    return e


def number(e: E, op: str) -> E:
    if is_null(e.type):
        return E(F.lit(None).cast(LONG), LONG)
    if not is_number(e.type):
        raise QueryError(f"{op} needs numbers, not {e.type.simpleString()}")
    return wide(e)


def text(e: E, op: str) -> Column:
    if is_null(e.type):
        return F.lit(None).cast(STRING)
    if not is_string(e.type):
        raise QueryError(f"{op} needs strings, not {e.type.simpleString()}")
    return e.col


def array(e: E, op: str) -> E:
    if is_null(e.type):
        return E(F.lit(None).cast(T.ArrayType(T.NullType())), T.ArrayType(T.NullType()))
    if not is_array(e.type):
        raise QueryError(f"{op} needs an array, not {e.type.simpleString()}")
    return e


def from_variant(e: E, like: T.DataType) -> E:
    """A variant as the kind of value that `like` is; null where it holds another kind."""
    if not isinstance(e.type, T.VariantType):
        return e
    kind = DOUBLE if is_number(like) else STRING if is_string(like) else BOOL if isinstance(like, T.BooleanType) else DATE if is_date(like) else like
    return E(F.try_variant_get(e.col, "$", kind.simpleString()), kind)


# --- comparison ------------------------------------------------------------------------------------------------------


def equal(a: E, b: E) -> Column:
    """Equality that is never null: null equals null, NaN equals NaN, values of different kinds differ."""
    a, b = from_variant(a, b.type), from_variant(b, a.type)
    if is_null(a.type) or is_null(b.type) or rank(a.type) != rank(b.type):
        return a.col.isNull() & b.col.isNull()
    if is_array(a.type) and a.type != b.type and rank(_element(a)) != rank(_element(b)) and 1 not in (rank(_element(a)), rank(_element(b))):
        return (a.col.isNull() & b.col.isNull()) | ((F.size(a.col) == 0) & (F.size(b.col) == 0) & a.col.isNotNull() & b.col.isNotNull())
    if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType) and a.type.names != b.type.names:
        return a.col.isNull() & b.col.isNull()  # objects differ by the order of their keys too
    if isinstance(a.type, T.MapType):
        return F.map_entries(a.col).eqNullSafe(F.map_entries(b.col))
    return a.col.eqNullSafe(b.col)


def _element(e: E) -> T.DataType:
    return e.type.elementType if is_array(e.type) else e.type


def less(a: E, b: E) -> Column:
    """a before b in the total order: null first, then by kind; NaN is the smallest number."""
    a, b = from_variant(a, b.type), from_variant(b, a.type)
    if is_null(b.type):
        return F.lit(False)
    if is_null(a.type):
        return b.col.isNotNull()
    if rank(a.type) != rank(b.type):
        return (a.col.isNull() & b.col.isNotNull()) | (b.col.isNotNull() & F.lit(rank(a.type) < rank(b.type)))
    plain = a.col < b.col
    if is_float(a.type) or is_float(b.type):
        nan_a, nan_b = (F.isnan(e.col) if is_float(e.type) else F.lit(False) for e in (a, b))
        plain = ~nan_b & (nan_a | (a.col < b.col))
    return F.coalesce(b.col.isNotNull() & (a.col.isNull() | plain), F.lit(False))


def truthy(e: E) -> Column:
    """Null, false and 0 are false; everything else is true."""
    if is_null(e.type):
        return F.lit(False)
    if isinstance(e.type, T.BooleanType):
        return e.col if e.certain else F.coalesce(e.col, F.lit(False))
    if is_number(e.type):
        return F.coalesce(e.col != 0, F.lit(False))
    return e.col.isNotNull()


# --- paths -----------------------------------------------------------------------------------------------------------


def step(e: E, name: str) -> E:
    """One step of an expression path: into an object, over an array's members, or to a numbered member."""
    if isinstance(e.type, T.StructType):
        if name in e.type.names:
            return E(e.col.getField(name), e.type[name].dataType)
        return E(F.lit(None), T.NullType())
    if isinstance(e.type, T.MapType):
        return E(F.try_element_at(e.col, F.lit(name)), e.type.valueType)
    if is_array(e.type):
        if name.isdigit():
            return E(F.get(e.col, F.lit(int(name))), e.type.elementType)
        inner = step(E(F.lit(None), e.type.elementType), name)
        if is_null(inner.type):
            return E(F.lit(None), T.NullType())
        return E(F.transform(e.col, lambda x: step(E(x, e.type.elementType), name).col), T.ArrayType(inner.type))
    if isinstance(e.type, T.VariantType):
        return E(F.try_variant_get(e.col, f"$.{name}", "variant"), e.type)
    return E(F.lit(None), T.NullType())


def resolve(scope: Scope, path: str) -> E:
    """A field path without its dollar sign."""
    head, *rest = path.split(".")
    if path in scope.fields:
        return scope.fields[path]
    found = scope.fields.get(head) or E(F.lit(None), T.NullType())
    for name in rest:
        found = step(found, name)
    return found


def variable(scope: Scope, path: str) -> E | Remove:
    head, *rest = path.split(".")
    if head == "REMOVE":
        return REMOVE
    if head in ("ROOT", "CURRENT") and head not in scope.variables:
        if rest:
            return resolve(scope, ".".join(rest))
        return scope.root()
    if head == "NOW":
        found = E(F.lit(scope.now or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)).cast(DATE), DATE)
    elif head in scope.variables:
        found = scope.variables[head]
    else:
        raise QueryError(f"undefined variable $${head}")
    for name in rest:
        found = step(found, name)
    return found


# --- literals and the compiler ---------------------------------------------------------------------------------------


def literal(value: Any) -> E:
    if isinstance(value, E):
        return value
    if value is None:
        return E(F.lit(None), T.NullType())
    if isinstance(value, bool):
        return E(F.lit(value), BOOL)
    if isinstance(value, int):
        return E(F.lit(value).cast(LONG), LONG)
    if isinstance(value, float):
        return E(F.lit(value), DOUBLE)
    if isinstance(value, str):
        return E(F.lit(value), STRING)
    if isinstance(value, Decimal):
        return E(F.lit(value).cast(DECIMAL), DECIMAL)
    if isinstance(value, datetime.datetime):
        if value.tzinfo:
            value = value.astimezone(datetime.UTC).replace(tzinfo=None)
        return E(F.lit(value.isoformat(sep=" ")).cast(DATE), DATE)
    if isinstance(value, datetime.date):
        return E(F.lit(value.isoformat()).cast(DATE), DATE)
    if isinstance(value, bytes | bytearray):
        return E(F.lit(bytes(value)), T.BinaryType())
    if isinstance(value, list | tuple):
        return array_of([literal(v) for v in value])
    if isinstance(value, dict):
        return struct_of({k: literal(v) for k, v in value.items()})
    raise QueryError(f"no literal of type {type(value).__name__}")


def array_of(items: list[E]) -> E:
    kind = common_type([e.type for e in items]) if items else T.NullType()
    if not items:
        return E(F.array(), T.ArrayType(kind))
    return E(F.array(*[cast(e, kind) for e in items]), T.ArrayType(kind))


Handler = Callable[[Any, Scope], "E | Remove"]
operators: dict[str, Handler] = {}


def register(*names: str) -> Callable[[Handler], Handler]:
    """Register an expression operator: a function of (specification, scope) that returns a typed column. This is also
    how users add their own; Python bodies can be wrapped as pandas UDFs inside."""

    def enter(handler: Handler) -> Handler:
        for name in names:
            operators[name] = handler
        return handler

    return enter


def compile_expression(spec: Any, scope: Scope) -> E | Remove:
    if isinstance(spec, str):
        if spec.startswith("$$"):
            return variable(scope, spec[2:])
        if spec.startswith("$") and len(spec) > 1:
            return resolve(scope, spec[1:])
        return literal(spec)
    if isinstance(spec, dict):
        if len(spec) == 1 and next(iter(spec)).startswith("$"):
            (name, inner), = spec.items()
            if name not in operators:
                raise UnsupportedOperator("aggregation expression operator", name)
            return operators[name](inner, scope)
        if any(k.startswith("$") for k in spec):
            raise QueryError(f"an expression object takes one operator: {list(spec)}")
        made = {k: compile_expression(v, scope) for k, v in spec.items()}
        return struct_of({k: e for k, e in made.items() if e is not REMOVE})
    if isinstance(spec, list | tuple):
        return array_of([value(v, scope) for v in spec])
    return literal(spec)


def value(spec: Any, scope: Scope) -> E:
    """An expression that is not `$$REMOVE` (which counts as null here)."""
    made = compile_expression(spec, scope)
    return E(F.lit(None), T.NullType()) if made is REMOVE else made


def arguments(spec: Any, scope: Scope, op: str, least: int, most: int | None = None) -> list[E]:
    """Compiled positional arguments; a single one needs no list."""
    items = list(spec) if isinstance(spec, list | tuple) else [spec]
    if len(items) < least or (most is not None and len(items) > most) or (most is None and least < 0):
        raise QueryError(f"{op} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(items)}")
    return [value(x, scope) for x in items]


def named(spec: Any, op: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, Any]:
    if not isinstance(spec, dict) or set(required) - set(spec) or set(spec) - set(required) - set(optional):
        raise QueryError(f"{op} takes {', '.join(required)}" + (f" and may take {', '.join(optional)}" if optional else ""))
    return spec


def constant(spec: Any, op: str) -> Any:
    """A value known when compiling."""
    if isinstance(spec, dict) and list(spec) == ["$literal"]:
        spec = spec["$literal"]
    if isinstance(spec, dict) or isinstance(spec, str) and spec.startswith("$"):
        raise QueryError(f"{op} needs a constant here")
    return spec


def null_if_any(args: list[E], result: Column) -> Column:
    """Null propagates."""
    test = F.lit(True)
    for e in args:
        test = test & e.col.isNotNull()
    return F.when(test, result)


def fail_when(condition: Column, message: str, otherwise: Column) -> Column:
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(otherwise)
