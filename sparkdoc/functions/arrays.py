"""Array and set operators."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .core import BOOL, LONG, E, Scope, arguments, array, cast, common_type, constant, equal, is_array, is_null, less, literal, named, null_if_any, number, register, step, struct_of, truthy, value


@register("$size")
def size(spec: Any, scope: Scope) -> E:
    e = array(arguments(spec, scope, "$size", 1, 1)[0], "$size")
    return E(F.when(e.col.isNotNull(), F.size(e.col)).cast(LONG), LONG)


def member(e: E, at: Column) -> Column:
    """Member by place, from the end if negative, null outside."""
    return F.get(e.col, F.when(at < 0, F.size(e.col) + at).otherwise(at).cast("int"))


@register("$arrayElemAt")
def array_elem_at(spec: Any, scope: Scope) -> E:
    items, at = arguments(spec, scope, "$arrayElemAt", 2, 2)
    items = array(items, "$arrayElemAt")
    return E(member(items, number(at, "$arrayElemAt").col), items.type.elementType)


@register("$first")
def first(spec: Any, scope: Scope) -> E:
    e = arguments(spec, scope, "$first", 1, 1)[0]
    return E(F.get(e.col, F.lit(0)), e.type.elementType) if is_array(e.type) else e


def _n(spec: Any, scope: Scope, op: str) -> tuple[E, Column]:
    named(spec, op, ("input", "n"))
    n = number(value(spec["n"], scope), op).col.cast("int")
    return array(value(spec["input"], scope), op), F.when(n < 1, F.raise_error(F.lit(f"{op} needs a positive n"))).otherwise(n)


@register("$firstN")
def first_n(spec: Any, scope: Scope) -> E:
    e, n = _n(spec, scope, "$firstN")
    return E(F.slice(e.col, F.lit(1), n), e.type)


@register("$lastN")
def last_n(spec: Any, scope: Scope) -> E:
    e, n = _n(spec, scope, "$lastN")
    return E(F.slice(e.col, F.greatest(F.size(e.col) - n, F.lit(0)) + 1, n), e.type)


def ascending(e: E) -> Column:
    """Sorted in the total order, nulls first."""
    return F.sort_array(e.col)


@register("$maxN")
def max_n(spec: Any, scope: Scope) -> E:
    e, n = _n(spec, scope, "$maxN")
    return E(F.slice(F.sort_array(F.filter(e.col, lambda x: x.isNotNull()), False), F.lit(1), n), e.type)


@register("$minN")
def min_n(spec: Any, scope: Scope) -> E:
    e, n = _n(spec, scope, "$minN")
    return E(F.slice(F.sort_array(F.filter(e.col, lambda x: x.isNotNull())), F.lit(1), n), e.type)


def cut(col: Column, n: Column | None, position: Column | None = None) -> Column:
    """n members from `position`; without a position the first n, or for a negative n the last."""
    total = F.size(col)
    if position is None:
        start, count = F.when(n < 0, F.greatest(total + n, F.lit(0))).otherwise(F.lit(0)), F.abs(n)
    else:
        start, count = F.when(position < 0, F.greatest(total + position, F.lit(0))).otherwise(position), n
    return F.slice(col, (start + 1).cast("int"), count.cast("int"))


@register("$slice")
def slice_(spec: Any, scope: Scope) -> E:
    items, *rest = arguments(spec, scope, "$slice", 2, 3)
    items = array(items, "$slice")
    numbers = [number(e, "$slice").col for e in rest]
    if len(numbers) == 2:
        count = F.when(numbers[1] <= 0, F.raise_error(F.lit("$slice needs a positive count after a position"))).otherwise(numbers[1])
        return E(cut(items.col, count, numbers[0]), items.type)
    return E(cut(items.col, numbers[0]), items.type)


@register("$concatArrays")
def concat_arrays(spec: Any, scope: Scope) -> E:
    args = [array(e, "$concatArrays") for e in arguments(spec, scope, "$concatArrays", 0)]
    kind = common_type([e.type for e in args]) if args else T.ArrayType(T.NullType())
    return E(F.concat(*[cast(e, kind) for e in args]) if args else F.array(), kind)


@register("$reverseArray")
def reverse_array(spec: Any, scope: Scope) -> E:
    e = array(arguments(spec, scope, "$reverseArray", 1, 1)[0], "$reverseArray")
    return E(F.reverse(e.col), e.type)


@register("$isArray")
def is_array_(spec: Any, scope: Scope) -> E:
    e = arguments(spec, scope, "$isArray", 1, 1)[0]
    return E(e.col.isNotNull() if is_array(e.type) else F.lit(False), BOOL)


@register("$indexOfArray")
def index_of_array(spec: Any, scope: Scope) -> E:
    items, wanted, *bounds = arguments(spec, scope, "$indexOfArray", 2, 4)
    items = array(items, "$indexOfArray")
    ends = [number(e, "$indexOfArray").col.cast("int") for e in bounds]
    start = ends[0] if ends else F.lit(0)
    end = F.least(ends[1], F.size(items.col)) if len(ends) > 1 else F.size(items.col)
    here = F.transform(items.col, lambda x, k: F.when((k >= start) & (k < end) & equal(E(x, items.type.elementType), wanted), k))
    found = F.coalesce(F.array_min(here), F.lit(-1)).cast(LONG)
    return E(null_if_any([items], found), LONG)


# --- higher-order ----------------------------------------------------------------------------------------------------


def lambda_type(spec: Any, scope: Scope, **variables: T.DataType) -> T.DataType:
    """The type of an expression over variables of the given types."""
    return value(spec, scope.bind(**{n: E(F.lit(None).cast(t) if not is_null(t) else F.lit(None), t) for n, t in variables.items()})).type


@register("$map")
def map_(spec: Any, scope: Scope) -> E:
    named(spec, "$map", ("input", "in"), ("as",))
    items, name = array(value(spec["input"], scope), "$map"), spec.get("as", "this")
    kind = lambda_type(spec["in"], scope, **{name: items.type.elementType})
    return E(F.transform(items.col, lambda x: value(spec["in"], scope.bind(**{name: E(x, items.type.elementType)})).col), T.ArrayType(kind))


@register("$filter")
def filter_(spec: Any, scope: Scope) -> E:
    named(spec, "$filter", ("input", "cond"), ("as",))
    items, name = array(value(spec["input"], scope), "$filter"), spec.get("as", "this")
    return E(F.filter(items.col, lambda x: truthy(value(spec["cond"], scope.bind(**{name: E(x, items.type.elementType)})))), items.type)


@register("$reduce")
def reduce_(spec: Any, scope: Scope) -> E:
    named(spec, "$reduce", ("input", "initialValue", "in"))
    items, start = array(value(spec["input"], scope), "$reduce"), value(spec["initialValue"], scope)
    kind = start.type
    for _ in range(3):  # until the accumulator's type holds its own result
        grown = common_type([kind, lambda_type(spec["in"], scope, value=kind, this=items.type.elementType)])
        if grown == kind:
            break
        kind = grown
    joined = F.aggregate(items.col, cast(start, kind), lambda acc, x: cast(value(spec["in"], scope.bind(value=E(acc, kind), this=E(x, items.type.elementType))), kind))
    return E(joined, kind)


@register("$zip")
def zip_(spec: Any, scope: Scope) -> E:
    named(spec, "$zip", ("inputs",), ("useLongestLength", "defaults"))
    if not isinstance(spec["inputs"], list) or not spec["inputs"]:
        raise QueryError("$zip needs inputs")
    inputs = [array(value(x, scope), "$zip") for x in spec["inputs"]]
    longest = bool(constant(spec.get("useLongestLength", False), "$zip"))
    defaults = [value(x, scope) for x in spec.get("defaults") or []]
    if defaults and (not longest or len(defaults) != len(inputs)):
        raise QueryError("$zip takes one default an input, with useLongestLength")
    kind = common_type([e.type.elementType for e in inputs] + [e.type for e in defaults])
    sizes = [F.size(e.col) for e in inputs]
    n = (F.greatest if longest else F.least)(*sizes) if len(sizes) > 1 else sizes[0]
    pick = lambda e, k, d: F.when(k < F.size(e.col), cast(E(F.get(e.col, k), e.type.elementType), kind)).otherwise(cast(d, kind) if d else F.lit(None).cast(kind))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array(*[pick(e, k, defaults[i] if defaults else None) for i, e in enumerate(inputs)]))
    out = T.ArrayType(T.ArrayType(kind))
    return E(null_if_any(inputs, F.when(n > 0, rows).otherwise(F.array().cast(out))), out)


def comparator(keys: list[tuple[str, int]], kind: T.DataType):
    """For array_sort: members by their paths, ascending (1) or descending (-1), nulls least."""

    def compare(a: Column, b: Column) -> Column:
        chain = F
        for path, direction in keys:
            left, right = E(a, kind), E(b, kind)
            for name in path.split(".") if path else []:
                left, right = step(left, name), step(right, name)
            chain = chain.when(less(left, right), F.lit(-direction)).when(less(right, left), F.lit(direction))
        return chain.otherwise(F.lit(0))

    return compare


def sort_keys(spec: Any, op: str) -> list[tuple[str, int]]:
    items = list(spec.items()) if isinstance(spec, dict) else [("", spec)]
    if not items or any(d not in (1, -1) or isinstance(d, bool) for _, d in items):
        raise QueryError(f"{op} sorts by 1 or -1")
    return items


@register("$sortArray")
def sort_array(spec: Any, scope: Scope) -> E:
    named(spec, "$sortArray", ("input", "sortBy"))
    e, keys = array(value(spec["input"], scope), "$sortArray"), sort_keys(spec["sortBy"], "$sortArray")
    if keys[0][0] == "":
        return E(F.sort_array(e.col, keys[0][1] == 1), e.type)
    return E(F.array_sort(e.col, comparator(keys, e.type.elementType)), e.type)


# --- sets ------------------------------------------------------------------------------------------------------------


def _sets(spec: Any, scope: Scope, op: str, least: int, most: int | None) -> tuple[list[E], T.DataType]:
    args = [array(e, op) for e in arguments(spec, scope, op, least, most)]
    kind = common_type([e.type for e in args])
    return [E(cast(e, kind), kind) for e in args], kind


@register("$setUnion")
def set_union(spec: Any, scope: Scope) -> E:
    args, kind = _sets(spec, scope, "$setUnion", 1, None)
    return E(F.array_distinct(F.concat(*[e.col for e in args])), kind)


@register("$setIntersection")
def set_intersection(spec: Any, scope: Scope) -> E:
    (a, b), kind = _sets(spec, scope, "$setIntersection", 2, 2)
    return E(F.array_intersect(a.col, b.col), kind)


@register("$setDifference")
def set_difference(spec: Any, scope: Scope) -> E:
    (a, b), kind = _sets(spec, scope, "$setDifference", 2, 2)
    return E(F.array_except(a.col, b.col), kind)


@register("$setEquals")
def set_equals(spec: Any, scope: Scope) -> E:
    args, _ = _sets(spec, scope, "$setEquals", 2, None)
    same = [(F.size(F.array_except(args[0].col, e.col)) == 0) & (F.size(F.array_except(e.col, args[0].col)) == 0) for e in args[1:]]
    return E(reduce(lambda x, y: x & y, same), BOOL)


@register("$setIsSubset")
def set_is_subset(spec: Any, scope: Scope) -> E:
    (a, b), _ = _sets(spec, scope, "$setIsSubset", 2, 2)
    return E(F.size(F.array_except(a.col, b.col)) == 0, BOOL)


@register("$allElementsTrue")
def all_elements_true(spec: Any, scope: Scope) -> E:
    e = array(arguments(spec, scope, "$allElementsTrue", 1, 1)[0], "$allElementsTrue")
    return E(F.forall(e.col, lambda x: truthy(E(x, e.type.elementType))), BOOL)


@register("$anyElementTrue")
def any_element_true(spec: Any, scope: Scope) -> E:
    e = array(arguments(spec, scope, "$anyElementTrue", 1, 1)[0], "$anyElementTrue")
    return E(F.exists(e.col, lambda x: truthy(E(x, e.type.elementType))), BOOL)


@register("$arrayToObject")
def array_to_object(spec: Any, scope: Scope) -> E:
    e = array(arguments(spec, scope, "$arrayToObject", 1, 1)[0], "$arrayToObject")
    inner = e.type.elementType
    if isinstance(inner, T.StructType) and inner.names == ["k", "v"]:
        pair, kind = (lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))), inner["v"].dataType
    elif is_array(inner):
        pair, kind = (lambda x: F.struct(F.get(x, F.lit(0)).cast("string").alias("k"), F.get(x, F.lit(1)).alias("v"))), inner.elementType
    else:
        raise QueryError("$arrayToObject needs members {k, v} or [k, v]")
    pairs = F.transform(e.col, pair)
    # of equal keys the last one's value counts, at the first one's place
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return E(F.map_from_entries(last), T.MapType(T.StringType(), kind))


@register("$objectToArray")
def object_to_array(spec: Any, scope: Scope) -> E:
    e = arguments(spec, scope, "$objectToArray", 1, 1)[0]
    if isinstance(e.type, T.MapType):
        return E(F.transform(F.map_entries(e.col), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"))), T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", e.type.valueType)])))
    if not isinstance(e.type, T.StructType):
        if is_null(e.type):
            return literal(None)
        raise QueryError("$objectToArray needs an object")
    kind = common_type([f.dataType for f in e.type.fields])
    items = [struct_of({"k": literal(f.name), "v": E(cast(E(e.col.getField(f.name), f.dataType), kind), kind)}) for f in e.type.fields]
    return E(F.when(e.col.isNotNull(), F.array(*[i.col for i in items])), T.ArrayType(items[0].type))
