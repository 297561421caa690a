"""`$setWindowFields`, lowered to window functions over hidden operand columns.

Partitions are Spark window partitions. Without partitionBy a window spans the whole input, which Spark can only run in
one task; that is what such a query asks for. `$expMovingAvg` carries its state over the sorted rows of a partition in one
pass, without gathering them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..errors import QueryError, UnsupportedOperator
from ..functions.arith import millis
from ..functions.core import DOUBLE, LONG, E, Scope, cast, common_type, constant, is_date, is_number, named, quote, resolve, value, wide
from .accumulators import NAMES, compile_accumulator
from .ordering import Key, Order, order_by
from .shapes import Tree, assign, concrete, tree_of

RANKS = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}
OTHERS = ("$shift", "$locf", "$linearFill", "$expMovingAvg", "$derivative", "$integral")
#: Milliseconds of the units of $derivative and $integral.
RATE = {"millisecond": 1.0, "second": 1e3, "minute": 6e4, "hour": 3.6e6, "day": 8.64e7, "week": 6.048e8}


def _bound(x: Any, low: bool) -> int:
    if x == "unbounded":
        return Window.unboundedPreceding if low else Window.unboundedFollowing
    if x == "current":
        return Window.currentRow
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    raise QueryError("window bounds are whole numbers, 'current' or 'unbounded'")


class Frames:
    """The window specifications of one stage."""

    def __init__(self, parts: list[str], keys: list[Key], ties: list[Key]):
        self.keys, self.all_keys = keys, [*keys, *ties]
        self.plain = Window.partitionBy(*[F.col(quote(p)) for p in parts])
        self.by_rank = self.plain.orderBy(*[c for k in keys for c in order_by(k)]) if keys else self.plain
        self.ordered = self.plain.orderBy(*[c for k in self.all_keys for c in order_by(k)]) if self.all_keys else self.plain

    def upto_current(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def from_current(self) -> WindowSpec:
        """This row and all behind it, seen from the end: frames that grow cost one step a row, frames that shrink all their
        rows. The next known value is the last one there."""
        return self.backwards().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def backwards(self) -> WindowSpec:
        turned = [Key(k.name, k.type, not k.ascending) for k in self.all_keys]
        return self.plain.orderBy(*[c for k in turned for c in order_by(k)]) if turned else self.plain

    def of(self, spec: dict | None) -> WindowSpec:
        """The frame of an output field; by default the whole partition."""
        if not spec:
            if not self.all_keys:
                return self.plain
            return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if set(spec) - {"documents", "range"} or len(spec) != 1:
            raise QueryError("a window takes documents or range")
        ((kind, bounds),) = spec.items()
        if not isinstance(bounds, list) or len(bounds) != 2:
            raise QueryError(f"{kind} takes two bounds")
        if not self.keys:
            raise QueryError("window bounds need sortBy")
        if kind == "documents":
            low, high = _bound(bounds[0], True), _bound(bounds[1], False)
            if high == Window.unboundedFollowing and low != Window.unboundedPreceding and self.all_keys:
                return self.backwards().rowsBetween(Window.unboundedPreceding, -low)
            return self.ordered.rowsBetween(low, high)
        if len(self.keys) != 1 or not is_number(self.keys[0].type):
            raise QueryError("range bounds need one numeric sort key")
        # bounds are offsets of the value, whatever the direction of the sort
        return self.plain.orderBy(F.col(quote(self.keys[0].name)).asc()).rangeBetween(_bound(bounds[0], True), _bound(bounds[1], False))


def set_window_fields(df: DataFrame, spec: Any, scope: Scope, ties: list[Key], within: tuple[str, ...] = ()) -> DataFrame:
    """The stage on typed columns. `ties`: the document order behind the sort keys; `within`: hidden columns that
    partition the documents before partitionBy does."""
    named(spec, "$setWindowFields", ("output",), ("partitionBy", "sortBy"))
    if not isinstance(spec["output"], dict) or not spec["output"]:
        raise QueryError("$setWindowFields needs an output")
    extra: dict[str, E] = {}
    parts = list(within)
    if spec.get("partitionBy") is not None:
        extra["__sd_p0"] = concrete(value(spec["partitionBy"], scope))
        parts.append("__sd_p0")
    keys: list[Key] = []
    for i, (path, direction) in enumerate((spec.get("sortBy") or {}).items()):
        if direction not in (1, -1) or isinstance(direction, bool):
            raise QueryError("sortBy takes 1 or -1")
        e = concrete(resolve(scope, path))
        extra[f"__sd_k{i}"] = e
        keys.append(Key(f"__sd_k{i}", e.type, direction == 1))
    frames = Frames(parts, keys, ties)
    order = Order([*keys, *ties])
    made: dict[str, E] = {}
    averages: dict[str, tuple[str, float]] = {}
    for i, (name, body) in enumerate(spec["output"].items()):
        ops = [k for k in body if k != "window"]
        if len(ops) != 1:
            raise QueryError(f"{name} takes one window operator")
        op, arg, window, prefix = ops[0], body[ops[0]], body.get("window"), f"__sd_w{i}_"
        if op in RANKS:
            if not keys or window or arg != {}:
                raise QueryError(f"{op} takes {{}}, sortBy and no window")
            made[name] = E(RANKS[op]().over(frames.ordered if op == "$documentNumber" else frames.by_rank).cast(LONG), LONG)
        elif op in NAMES:
            compiled = compile_accumulator(op, arg, scope, prefix)
            extra |= compiled.inputs
            made[name] = E(compiled.build(order, frames.of(window)), compiled.type)
        elif op in OTHERS:
            if op not in ("$derivative", "$integral") and window:
                raise QueryError(f"{op} takes no window")
            if op != "$shift" and not keys and op != "$locf":
                raise QueryError(f"{op} needs sortBy")
            made[name] = _OTHERS[op](arg, scope, prefix, extra, frames, window, averages)
        else:
            raise UnsupportedOperator("window operator", op)
    wide_df = df.withColumns({n: e.col for n, e in extra.items()}) if extra else df
    numbered = any("$linearFill" in body for body in spec["output"].values())
    if numbered:
        wide_df = wide_df.withColumn("__sd_rn", F.row_number().over(frames.ordered))
    if averages:
        wide_df = _moving_averages(wide_df, averages, frames.ordered)
    tree = tree_of({n: made[n] for n in spec["output"]})
    fields = dict(scope.fields)
    hidden_names = {n: f"__sd_o{i}" for i, n in enumerate(made)}
    # results become columns first, then they are set at their (perhaps nested) places
    results = wide_df.withColumns({hidden_names[n]: made[n].col for n in made})
    out: dict[str, Column] = {}
    leaf = {n: E(F.col(hidden_names[n]), made[n].type) for n in made}

    def place(node: Any, own: E | None) -> E:
        return leaf[next(n for n, e in made.items() if e is node)]

    for top, node in tree.items():
        out[top] = (assign(fields.get(top), node, place) if isinstance(node, Tree) else place(node, None)).col
    done = results.withColumns(out)
    return done.drop(*extra, *hidden_names.values(), *averages, "__sd_rn")


def _input(e: E, prefix: str, extra: dict[str, E], k: int = 0) -> E:
    e = concrete(e)
    extra[f"{prefix}{k}"] = e
    return E(F.col(f"{prefix}{k}"), e.type)


def _shift(arg: Any, scope: Scope, prefix: str, extra: dict, frames: Frames, window: Any, averages: dict) -> E:
    named(arg, "$shift", ("output", "by"), ("default",))
    by = constant(arg["by"], "$shift")
    if not isinstance(by, int) or isinstance(by, bool):
        raise QueryError("$shift takes a whole number as by")
    e, default = value(arg["output"], scope), value(arg.get("default"), scope)
    kind = common_type([e.type, default.type])
    x = _input(E(cast(e, kind), kind), prefix, extra)
    # the default fills in where no document is, not where its value is null
    there = F.lead(F.struct(x.col.alias("v")), by).over(frames.ordered) if by >= 0 else F.lag(F.struct(x.col.alias("v")), -by).over(frames.ordered)
    if by == 0:
        return x
    return E(F.when(there.isNull(), cast(default, x.type)).otherwise(there["v"]), x.type)


def _locf(arg: Any, scope: Scope, prefix: str, extra: dict, frames: Frames, window: Any, averages: dict) -> E:
    x = _input(value(arg, scope), prefix, extra)
    return E(F.last(x.col, ignorenulls=True).over(frames.upto_current()), x.type)


def _linear_fill(arg: Any, scope: Scope, prefix: str, extra: dict, frames: Frames, window: Any, averages: dict) -> E:
    x = _input(value(arg, scope), prefix, extra)
    return interpolate(x, frames)


def interpolate(x: E, frames: Frames) -> E:
    """Between known values by position; edges stay null. `__sd_rn` is the row's number in its partition."""
    before = F.last(x.col, ignorenulls=True).over(frames.upto_current())
    after = F.last(x.col, ignorenulls=True).over(frames.from_current())
    known = F.when(x.col.isNotNull(), F.col("__sd_rn"))
    since = F.col("__sd_rn") - F.last(known, ignorenulls=True).over(frames.upto_current())
    until = F.last(known, ignorenulls=True).over(frames.from_current()) - F.col("__sd_rn")
    share = since / (since + until)
    if is_date(x.type):
        ms = F.unix_micros(before.cast("timestamp")) + (F.unix_micros(after.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) * share
        mid = F.timestamp_micros(F.round(ms).cast(LONG)).cast(x.type)
        return E(F.when(x.col.isNotNull(), x.col).otherwise(mid), x.type)
    mid = before.cast(DOUBLE) + (after.cast(DOUBLE) - before.cast(DOUBLE)) * share
    return E(F.when(x.col.isNotNull(), x.col.cast(DOUBLE)).otherwise(mid), DOUBLE)


def _exp_moving_avg(arg: Any, scope: Scope, prefix: str, extra: dict, frames: Frames, window: Any, averages: dict) -> E:
    named(arg, "$expMovingAvg", ("input",), ("N", "alpha"))
    if ("N" in arg) == ("alpha" in arg):
        raise QueryError("$expMovingAvg takes N or alpha")
    alpha = 2 / (constant(arg["N"], "$expMovingAvg") + 1) if "N" in arg else float(constant(arg["alpha"], "$expMovingAvg"))
    if not 0 < alpha <= 1:
        raise QueryError("$expMovingAvg takes a positive N or an alpha between 0 and 1")
    x = _input(E(wide(value(arg["input"], scope)).col.cast(DOUBLE), DOUBLE), prefix, extra)
    averages[f"{prefix}ema"] = (f"{prefix}0", alpha)
    del x
    return E(F.col(f"{prefix}ema"), DOUBLE)


def _moving_averages(df: DataFrame, averages: dict[str, tuple[str, float]], ordered: WindowSpec) -> DataFrame:
    """The rows with their averages attached, in one pass over the sorted partitions; memory is one Arrow batch."""
    fields, sources = df.schema.fields, list(averages.values())
    kinds = [*fields, *[StructField(n, DoubleType()) for n in averages]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[float | None] = [None] * len(sources)
        for batch in batches:
            first, columns = batch.column(len(fields)).to_pylist(), []
            for k, (source, alpha) in enumerate(sources):
                out, state = [], now[k]
                for new, x in zip(first, batch.column(batch.schema.get_field_index(source)).to_pylist(), strict=True):
                    if new:
                        state = None
                    if x is not None:
                        state = x if state is None else x * alpha + state * (1 - alpha)
                    out.append(state)
                now[k] = state
                columns.append(pa.array(out, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *columns], names=[f.name for f in kinds])

    # the window leaves each of its partitions sorted and in one piece; __sd_new marks where one begins
    return df.withColumn("__sd_new", F.row_number().over(ordered) == 1).mapInArrow(run, StructType(kinds))


def _axis(frames: Frames, op: str) -> tuple[Column, bool]:
    if len(frames.keys) != 1 or not (is_number(frames.keys[0].type) or is_date(frames.keys[0].type)):
        raise QueryError(f"{op} needs one sort key, a number or a date")
    key = frames.keys[0].e
    return (millis(key).cast(DOUBLE), True) if is_date(key.type) else (key.col.cast(DOUBLE), False)


def _rate(arg: Any, scope: Scope, prefix: str, extra: dict, frames: Frames, op: str) -> tuple[Column, Column, float]:
    named(arg, op, ("input",), ("unit",))
    at, dated = _axis(frames, op)
    unit = constant(arg.get("unit"), op)
    if unit is not None and (unit not in RATE or not dated):
        raise QueryError(f"{op} takes a unit for dates only")
    x = _input(E(wide(value(arg["input"], scope)).col.cast(DOUBLE), DOUBLE), prefix, extra)
    return x.col, at, RATE[unit] if unit else 1.0


def _derivative(arg: Any, scope: Scope, prefix: str, extra: dict, frames: Frames, window: Any, averages: dict) -> E:
    x, at, scale = _rate(arg, scope, prefix, extra, frames, "$derivative")
    point = F.when(x.isNotNull(), F.struct(at.alias("t"), x.alias("x")))
    w = frames.of(window)
    a, b = F.first(point, ignorenulls=True).over(w), F.last(point, ignorenulls=True).over(w)
    gap = (b["t"] - a["t"]) / F.lit(scale)
    return E(F.when((F.count(x).over(w) >= 2) & (gap != 0), (b["x"] - a["x"]) / gap), DOUBLE)


def _integral(arg: Any, scope: Scope, prefix: str, extra: dict, frames: Frames, window: Any, averages: dict) -> E:
    x, at, scale = _rate(arg, scope, prefix, extra, frames, "$integral")
    point = F.struct(at.alias("t"), x.alias("x"))
    w = frames.of(window)
    points = F.filter(F.collect_list(F.when(x.isNotNull(), point)).over(w), lambda p: p.isNotNull())
    areas = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: (b["t"] - a["t"]) / F.lit(scale) * (a["x"] + b["x"]) / 2)
    return E(F.when(F.size(points) >= 2, F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)), DOUBLE)


_OTHERS = {"$shift": _shift, "$locf": _locf, "$linearFill": _linear_fill, "$expMovingAvg": _exp_moving_avg, "$derivative": _derivative, "$integral": _integral}
