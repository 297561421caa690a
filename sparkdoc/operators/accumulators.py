"""Accumulators of `$group`, `$bucket`, `$bucketAuto` and `$setWindowFields`.

An accumulator is compiled in two steps: its operands become hidden columns (so that both aggregation and windows see
plain names), then an aggregate over them is built. Everything that Spark can combine map-side is; lists, exact
percentiles and n-element forms keep a group's values, as their results do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedOperator
from ..functions.arith import check_method, nearest_rank, numbers_of, shares, total
from ..functions.arrays import sort_keys
from ..functions.core import DOUBLE, LONG, E, Scope, constant, is_array, is_float, is_null, is_number, named, quote, value, wide
from .ordering import Key, Order, sortable

#: Those that depend on the order of documents.
ORDERED = {"$first", "$last", "$firstN", "$lastN", "$push", "$addToSet", "$mergeObjects", "$top", "$topN", "$bottom", "$bottomN"}


@dataclass
class Compiled:
    """Hidden operand columns, the aggregate over them, its type, and what it is for no documents at all."""

    type: T.DataType
    build: Callable[[Order, Any], Column]
    inputs: dict[str, E] = field(default_factory=dict)
    empty: Column | None = None


class Inputs:
    """Names for operand columns."""

    def __init__(self, prefix: str):
        self.prefix, self.made = prefix, {}

    def add(self, e: E) -> E:
        if is_null(e.type):
            e = E(e.col.cast("string"), T.StringType())
        name = f"{self.prefix}{len(self.made)}"
        self.made[name] = e
        return E(F.col(quote(name)), e.type)


def _over(c: Column, over: Any) -> Column:
    return c if over is None else c.over(over)


def _numeric(e: E) -> E | None:
    return wide(e) if is_number(e.type) else None


def compile_accumulator(op: str, spec: Any, scope: Scope, prefix: str) -> Compiled:
    inputs = Inputs(prefix)
    if op not in _BUILDERS:
        raise UnsupportedOperator("accumulator", op)
    made = _BUILDERS[op](spec, scope, inputs, op)
    made.inputs = inputs.made
    return made


def _sum(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    e = value(spec, scope)
    if is_array(e.type):
        numbers = numbers_of(spec, scope)
        e = E(total(numbers), numbers.type.elementType)
    e = _numeric(e) or E(F.lit(0).cast(LONG), LONG)
    x = inputs.add(e)
    zero = F.lit(0).cast(e.type)
    return Compiled(e.type, lambda order, over: F.coalesce(_over(F.sum(x.col), over), zero).cast(e.type), empty=zero)


def _count(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    if spec != {}:
        raise QueryError("$count takes {}")
    return Compiled(LONG, lambda order, over: _over(F.count(F.lit(1)), over), empty=F.lit(0).cast(LONG))


def _avg(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    e = _numeric(value(spec, scope))
    x = inputs.add(E(e.col.cast(DOUBLE), DOUBLE) if e else E(F.lit(None).cast(DOUBLE), DOUBLE))
    return Compiled(DOUBLE, lambda order, over: _over(F.avg(x.col), over))


def _extreme(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    x = inputs.add(value(spec, scope))
    plain = F.min if op == "$min" else F.max

    def build(order: Order, over: Any) -> Column:
        if not is_float(x.type):
            return _over(plain(x.col), over)
        if op == "$min":  # NaN is the smallest number
            return F.when(_over(F.max(F.isnan(x.col) & x.col.isNotNull()), over), F.lit(float("nan")).cast(x.type)).otherwise(_over(F.min(x.col), over))
        return F.coalesce(_over(F.max(F.when(~F.isnan(x.col), x.col)), over), _over(F.max(x.col), over))

    return Compiled(x.type, build)


def _ends(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    x = inputs.add(value(spec, scope))
    return Compiled(x.type, lambda order, over: order.first(x.col, over) if op == "$first" else order.last(x.col, over))


def _n_of(spec: Any, op: str, *more: str) -> int:
    n = constant(named(spec, op, ("n", *more))["n"], op)
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise QueryError(f"{op} takes a positive whole n")
    return n


def head(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def tail(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, F.lit(n))


def _n_ends(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    n = _n_of(spec, op, "input")
    x = inputs.add(value(spec["input"], scope))
    kind = T.ArrayType(x.type)
    cut = head if op == "$firstN" else tail
    return Compiled(kind, lambda order, over: cut(order.list(x.col, over), n), empty=F.array().cast(kind))


def _n_extremes(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    n = _n_of(spec, op, "input")
    x = inputs.add(value(spec["input"], scope))
    kind = T.ArrayType(x.type)
    return Compiled(kind, lambda order, over: head(F.sort_array(_over(F.collect_list(x.col), over), op == "$minN"), n), empty=F.array().cast(kind))


def _top(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    many = op in ("$topN", "$bottomN")
    n = _n_of(spec, op, "sortBy", "output") if many else 1
    named(spec, op, ("sortBy", "output"), ("n",) if many else ())
    x = inputs.add(value(spec["output"], scope))
    keys = []
    for path, direction in sort_keys(spec["sortBy"], op):
        k = inputs.add(sortable(value("$" + path, scope), direction == 1))
        keys.append(Key(_name(k, inputs), k.type, direction == 1))
    bottom = op in ("$bottom", "$bottomN")

    def build(order: Order, over: Any) -> Column:
        forward = Order([*keys, *order.keys])
        chosen = forward.reversed(len(keys)) if bottom else forward
        if not many:
            return chosen.first(x.col, over)
        if not bottom:
            return head(chosen.list(x.col, over), n)
        # the last n, the earliest of ties; back in sort order, ties in document order
        rows = chosen.list(F.struct(*[k.e.col.alias(f"k{i}") for i, k in enumerate(forward.keys)], x.col.alias("v")), over)
        return F.transform(F.array_sort(head(rows, n), forward._compare), lambda r: r["v"])

    kind = T.ArrayType(x.type) if many else x.type
    return Compiled(kind, build, empty=F.array().cast(kind) if many else None)


def _name(e: E, inputs: Inputs) -> str:
    return f"{inputs.prefix}{len(inputs.made) - 1}"


def _push(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    x = inputs.add(value(spec, scope))
    kind = T.ArrayType(x.type)
    empty = F.array().cast(kind)
    if op == "$push":
        return Compiled(kind, lambda order, over: F.coalesce(order.list(x.col, over), empty), empty=empty)
    return Compiled(kind, lambda order, over: F.coalesce(F.array_distinct(order.list(x.col, over)), empty), empty=empty)


def _merge(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    x = inputs.add(value(spec, scope))
    if not isinstance(x.type, T.StructType):
        raise QueryError("$mergeObjects needs objects")

    def build(order: Order, over: Any) -> Column:
        parts = []
        for f in x.type.fields:
            v = x.col.getField(f.name)
            if order.key is not None:
                last = _over(F.max_by(F.struct(v.alias("v")), F.when(v.isNotNull(), order.key)), over)["v"]
            else:
                last = F.get(F.reverse(order.list(v, over, v.isNotNull())), F.lit(0))
            parts.append(last.alias(f.name))
        return F.struct(*parts)

    return Compiled(x.type, build)


def _deviation(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    e = _numeric(value(spec, scope))
    x = inputs.add(E(e.col.cast(DOUBLE), DOUBLE) if e else E(F.lit(None).cast(DOUBLE), DOUBLE))
    plain = F.stddev_pop if op == "$stdDevPop" else F.stddev_samp
    odd = F.isnan(x.col) | (F.abs(x.col) == float("inf"))
    return Compiled(DOUBLE, lambda order, over: F.when(~F.coalesce(_over(F.max(odd), over), F.lit(False)), _over(plain(x.col), over)))


def _percentiles(spec: Any, scope: Scope, inputs: Inputs, op: str) -> Compiled:
    many = op == "$percentile"
    check_method(named(spec, op, ("input", "p", "method") if many else ("input", "method")), op)
    ps = shares(spec["p"], op) if many else [0.5]
    e = _numeric(value(spec["input"], scope)) or E(F.lit(None).cast(LONG), LONG)
    x = inputs.add(e)
    kind = T.ArrayType(e.type) if many else e.type
    name = quote(_name(x, inputs))

    def build(order: Order, over: Any) -> Column:
        if over is not None:
            ordered = F.sort_array(_over(F.collect_list(x.col), over))
            found = [nearest_rank(ordered, p) for p in ps]
        else:
            found = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})").cast(e.type) for p in ps]
        return F.array(*found) if many else found[0]

    return Compiled(kind, build, empty=F.array(*[F.lit(None).cast(e.type) for _ in ps]) if many else None)


_BUILDERS = {
    "$sum": _sum, "$count": _count, "$avg": _avg, "$min": _extreme, "$max": _extreme, "$first": _ends, "$last": _ends,
    "$firstN": _n_ends, "$lastN": _n_ends, "$maxN": _n_extremes, "$minN": _n_extremes, "$top": _top, "$topN": _top,
    "$bottom": _top, "$bottomN": _top, "$push": _push, "$addToSet": _push, "$mergeObjects": _merge,
    "$stdDevPop": _deviation, "$stdDevSamp": _deviation, "$median": _percentiles, "$percentile": _percentiles,
}

#: Names of all accumulators.
NAMES = frozenset(_BUILDERS)


def compile_output(output: dict[str, Any], scope: Scope, op: str) -> dict[str, tuple[str, Compiled]]:
    """{field: (operator, compiled)} of a document of accumulators."""
    made = {}
    for k, (name, spec) in enumerate(output.items()):
        if not isinstance(spec, dict) or len(spec) != 1 or "." in name or name.startswith("$"):
            raise QueryError(f"{op}: {name} takes one accumulator")
        ((acc, inner),) = spec.items()
        made[name] = (acc, compile_accumulator(acc, inner, scope, f"__sd_a{k}_"))
    return made
