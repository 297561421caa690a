"""Object and type operators."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .core import BOOL, LONG, REMOVE, STRING, E, Scope, alias_of, arguments, cast, common_type, compile_expression, constant, is_array, is_date, is_float, is_int, is_null, is_number, is_string, literal, named, register, struct_of, value


def merge(objects: list[E]) -> E:
    """Right-most non-missing value of each field; null objects are skipped."""
    objects = [e for e in objects if not is_null(e.type)]
    if any(isinstance(e.type, T.MapType) for e in objects):
        kind = common_type([e.type.valueType for e in objects if isinstance(e.type, T.MapType)])
        to = T.MapType(STRING, kind)
        entries = F.flatten(F.array(*[F.coalesce(F.map_entries(e.col.cast(to)), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", STRING, False), T.StructField("value", kind)])))) for e in objects]))
        last = F.filter(entries, lambda p, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda q: q["key"] == p["key"]))
        return E(F.map_from_entries(last), to)
    if any(not isinstance(e.type, T.StructType) for e in objects):
        raise QueryError("$mergeObjects needs objects")
    names = list(dict.fromkeys(n for e in objects for n in e.type.names))
    out = {}
    for n in names:
        having = [E(e.col.getField(n), e.type[n].dataType) for e in objects if n in e.type.names]
        kind = common_type([h.type for h in having]) if len({rank_key(h.type) for h in having}) == 1 else having[-1].type
        out[n] = E(F.coalesce(*[cast(h, kind) for h in reversed(having) if rank_key(h.type) == rank_key(kind)]), kind)
    return struct_of(out)


def rank_key(t: T.DataType) -> str:
    return "number" if is_number(t) else t.typeName()


@register("$mergeObjects")
def merge_objects(spec: Any, scope: Scope) -> E:
    args = arguments(spec, scope, "$mergeObjects", 1)
    if len(args) == 1 and is_array(args[0].type):
        items = args[0]
        if not isinstance(items.type.elementType, T.StructType):
            raise QueryError("$mergeObjects needs objects")
        kind = items.type.elementType
        pick = lambda n: F.get(F.reverse(F.filter(F.transform(items.col, lambda x: x[n]), lambda x: x.isNotNull())), F.lit(0))
        return struct_of({f.name: E(pick(f.name), f.dataType) for f in kind.fields})
    return merge(args)


@register("$getField")
def get_field(spec: Any, scope: Scope) -> E:
    if not isinstance(spec, dict):
        spec = {"field": spec, "input": "$$CURRENT"}
    named(spec, "$getField", ("field",), ("input",))
    name, source = constant(spec["field"], "$getField"), value(spec.get("input", "$$CURRENT"), scope)
    if isinstance(source.type, T.StructType) and name in source.type.names:
        return E(source.col.getField(name), source.type[name].dataType)
    if isinstance(source.type, T.MapType):
        return E(F.try_element_at(source.col, F.lit(name)), source.type.valueType)
    return literal(None)


@register("$setField")
def set_field(spec: Any, scope: Scope) -> E:
    named(spec, "$setField", ("field", "input", "value"))
    name, source, new = constant(spec["field"], "$setField"), value(spec["input"], scope), compile_expression(spec["value"], scope)
    if not isinstance(source.type, T.StructType):
        raise QueryError("$setField needs an object")
    fields = {f.name: E(source.col.getField(f.name), f.dataType) for f in source.type.fields}
    if new is REMOVE:
        fields.pop(name, None)
    else:
        fields[name] = new
    made = struct_of(fields)
    return E(F.when(source.col.isNotNull(), made.col), made.type)


@register("$unsetField")
def unset_field(spec: Any, scope: Scope) -> E:
    named(spec, "$unsetField", ("field", "input"))
    return set_field(spec | {"value": "$$REMOVE"}, scope)


@register("$type")
def type_(spec: Any, scope: Scope) -> E:
    e = arguments(spec, scope, "$type", 1, 1)[0]
    if is_null(e.type):
        return literal("missing")
    return E(F.when(e.col.isNull(), F.lit("null")).otherwise(F.lit(alias_of(e.type))), STRING)


@register("$isNumber")
def is_number_(spec: Any, scope: Scope) -> E:
    e = arguments(spec, scope, "$isNumber", 1, 1)[0]
    return E(e.col.isNotNull() if is_number(e.type) else F.lit(False), BOOL)


@register("$binarySize")
def binary_size(spec: Any, scope: Scope) -> E:
    e = arguments(spec, scope, "$binarySize", 1, 1)[0]
    if not (isinstance(e.type, T.BinaryType) or is_string(e.type) or is_null(e.type)):
        raise QueryError("$binarySize needs binary data")
    return E(F.octet_length(e.col).cast(LONG), LONG)


def _bytes(e: E) -> Column:
    """Encoded size of a value without its name: what the binary document format needs."""
    t = e.type
    if isinstance(t, T.StructType):
        return F.coalesce(_document(e), F.lit(0))
    if isinstance(t, T.MapType):
        parts = F.transform(F.map_entries(e.col), lambda p: F.octet_length(p["key"]) + 2 + _bytes(E(p["value"], t.valueType)))
        return 5 + F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    if is_array(t):
        # members are named by their places: 1 digit and the terminator, and one more for each power of ten
        parts = F.transform(e.col, lambda x, k: F.char_length(k.cast("string")) + 2 + F.when(x.isNull(), F.lit(0)).otherwise(_bytes(E(x, t.elementType))))
        return 5 + F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    if is_string(t):
        return F.octet_length(e.col) + 5
    if isinstance(t, T.BinaryType):
        return F.octet_length(e.col) + 5
    if isinstance(t, T.BooleanType):
        return F.lit(1)
    if isinstance(t, T.DecimalType):
        return F.lit(16)
    if is_int(t) and not isinstance(t, T.LongType):
        return F.lit(4)
    if is_int(t) or is_float(t) or is_date(t):
        return F.lit(8)
    return F.lit(0)


def _document(e: E) -> Column:
    total = F.lit(5)
    for f in e.type.fields:
        part = E(e.col.getField(f.name), f.dataType)
        total = total + F.when(part.col.isNull(), F.lit(0)).otherwise(len(f.name.encode()) + 2 + _bytes(part))
    return total


@register("$bsonSize")
def bson_size(spec: Any, scope: Scope) -> E:
    e = arguments(spec, scope, "$bsonSize", 1, 1)[0]
    if not isinstance(e.type, T.StructType | T.MapType):
        raise QueryError("$bsonSize needs an object")
    return E(F.when(e.col.isNotNull(), _bytes(e)).cast(LONG), LONG)


