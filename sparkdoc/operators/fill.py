"""`$densify` and `$fill`."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.core import DATE, DOUBLE, LONG, E, Scope, cast, common_type, is_date, is_int, is_number, literal, named, resolve, wide
from ..functions.dates import MICROS, from_micros, micros
from .ordering import Key, order_by
from .shapes import Tree, assign, concrete, tree_of
from .windows import Frames, interpolate


def _partitions(spec: dict, op: str, scope: Scope) -> dict[str, E]:
    paths = spec.get("partitionByFields") or []
    if not isinstance(paths, list) or not all(isinstance(p, str) and p for p in paths):
        raise QueryError(f"{op} takes partitionByFields as a list of paths")
    return {p: concrete(resolve(scope, p)) for p in paths}


def densify(df: DataFrame, spec: Any, scope: Scope, ties: list[Key]) -> DataFrame:
    """Documents on the grid lower, lower + step, ... up to upper in every partition, one a value: the last one that has
    it, or a new one with the partition's fields. Others are dropped. "full" is from a partition's least to its
    greatest value. The grid comes from `sequence`, one array a partition, and meets the documents in one join."""
    named(spec, "$densify", ("field", "range"), ("partitionByFields",))
    named(spec["range"], "$densify range", ("step", "bounds"), ("unit",))
    step, unit, bounds = spec["range"]["step"], spec["range"].get("unit"), spec["range"]["bounds"]
    if not isinstance(step, int | float) or isinstance(step, bool) or step <= 0:
        raise QueryError("$densify takes a positive step")
    e = resolve(scope, spec["field"])
    parts = _partitions(spec, "$densify", scope)
    dated = is_date(e.type)
    if dated:
        if unit not in ("millisecond", "second", "minute", "hour", "day"):
            raise QueryError("$densify takes a unit from millisecond to day for dates")
        width: Any = int(step * MICROS[unit])
        at, back = micros(e.col), lambda c: from_micros(c).cast(e.type)
        fixed = (lambda x: micros(literal(x).col))
    elif is_number(e.type):
        whole = is_int(e.type) and isinstance(step, int) and (bounds == "full" or all(isinstance(b, int) for b in bounds))
        kind = LONG if whole else DOUBLE
        width, at, back, fixed = step, e.col.cast(kind), (lambda c: c), (lambda x: F.lit(x).cast(kind))
    else:
        raise QueryError("$densify takes numbers or dates")
    names = {p: f"__sd_p{i}" for i, p in enumerate(parts)}
    base = df.withColumns({names[p]: x.col for p, x in parts.items()} | {"__sd_at": at})
    base = base.withColumn("__sd_at", F.when(F.col("__sd_at").isNull(), F.raise_error(F.lit("$densify needs the field in every document"))).otherwise(F.col("__sd_at")))
    keys = [F.col(n) for n in names.values()]
    ends = base.groupBy(*keys).agg(F.min("__sd_at").alias("lo"), F.max("__sd_at").alias("hi")) if keys else base.agg(F.min("__sd_at").alias("lo"), F.max("__sd_at").alias("hi")).where("lo is not null")
    if bounds != "full":
        if not isinstance(bounds, list) or len(bounds) != 2:
            raise QueryError("$densify takes bounds 'full' or [lower, upper]")
        ends = ends.withColumns({"lo": fixed(bounds[0]), "hi": fixed(bounds[1])})
    if dated or is_int(e.type) and isinstance(width, int):
        grid_values = F.sequence("lo", "hi", F.lit(width).cast("long" if dated or isinstance(width, int) else DOUBLE))
    else:
        count = F.floor((F.col("hi") - F.col("lo")) / F.lit(float(width)) + 1e-9).cast("int")
        grid_values = F.transform(F.sequence(F.lit(0), count), lambda k: F.col("lo") + k * F.lit(width))
    grid = ends.where("lo <= hi").select(*[F.col(n).alias(f"{n}g") for n in names.values()], F.explode(grid_values).alias("__sd_atg"))
    backwards = [c for k in ties for c in order_by(Key(k.name, k.type, not k.ascending))]
    last = Window.partitionBy(*keys, "__sd_at").orderBy(*(backwards or [F.lit(0)]))
    single = base.withColumn("__sd_rank", F.row_number().over(last)).where("__sd_rank = 1").drop("__sd_rank").withColumn("__sd_here", F.lit(True))
    on = F.col("__sd_at") == F.col("__sd_atg")
    for n in names.values():
        on = on & F.col(n).eqNullSafe(F.col(f"{n}g"))
    joined = grid.join(single, on, "left")
    whole_steps = is_int(e.type) and isinstance(width, int)
    created = {spec["field"]: E(back(F.col("__sd_atg")).cast(DATE if dated else LONG if whole_steps else DOUBLE), DATE if dated else LONG if whole_steps else DOUBLE)}
    created |= {p: E(F.col(f"{names[p]}g"), x.type) for p, x in parts.items()}
    tree = tree_of(created)
    out = []
    for name, own in scope.fields.items():
        if name in tree:
            node = tree[name]
            new = assign(None, node, lambda leaf, _: leaf) if isinstance(node, Tree) else node
            kind = common_type([own.type, new.type])
            out.append(F.when(F.col("__sd_here"), cast(own, kind)).otherwise(cast(new, kind)).alias(name))
        else:
            out.append(own.col.alias(name))
    return joined.select(*out)


def fill(df: DataFrame, spec: Any, scope: Scope, ties: list[Key]) -> DataFrame:
    """Nulls replaced by a value, the last known one, or by interpolation between known ones by row position."""
    named(spec, "$fill", ("sortBy", "output"), ("partitionByFields",))
    if not isinstance(spec["sortBy"], dict) or len(spec["sortBy"]) != 1 or not spec["output"]:
        raise QueryError("$fill takes one sort field and an output")
    ((path, direction),) = spec["sortBy"].items()
    if direction not in (1, -1) or isinstance(direction, bool):
        raise QueryError("$fill sorts by 1 or -1")
    parts = _partitions(spec, "$fill", scope)
    key = concrete(resolve(scope, path))
    extra = {f"__sd_p{i}": x for i, x in enumerate(parts.values())} | {"__sd_k0": key}
    frames = Frames([f"__sd_p{i}" for i in range(len(parts))], [Key("__sd_k0", key.type, direction == 1)], ties)
    base = df.withColumns({n: x.col for n, x in extra.items()})
    if any(isinstance(how, dict) and how.get("method") == "linear" for how in spec["output"].values()):
        base = base.withColumn("__sd_rn", F.row_number().over(frames.ordered))
    leaves: dict[str, E] = {}
    for i, (name, how) in enumerate(spec["output"].items()):
        if not isinstance(how, dict) or len(how) != 1:
            raise QueryError("$fill takes a value or a method for each field")
        x = resolve(scope, name)
        if "value" in how:
            new = literal(how["value"])
            kind = common_type([x.type, new.type])
            leaves[name] = E(F.coalesce(cast(x, kind), cast(new, kind)), kind)
            continue
        x = concrete(wide(x))
        base = base.withColumn(f"__sd_x{i}", x.col)
        x = E(F.col(f"__sd_x{i}"), x.type)
        if how.get("method") == "locf":
            leaves[name] = E(F.last(x.col, ignorenulls=True).over(frames.upto_current()), x.type)
        elif how.get("method") == "linear":
            if not (is_number(x.type) or is_date(x.type)):
                raise QueryError("$fill linear takes numbers or dates")
            leaves[name] = interpolate(x, frames)
        else:
            raise QueryError("$fill knows the methods locf and linear")
    base = base.withColumns({f"__sd_f{i}": e.col for i, e in enumerate(leaves.values())})
    done = {n: E(F.col(f"__sd_f{i}"), e.type) for i, (n, e) in enumerate(leaves.items())}
    out: dict[str, Column] = {}
    for top, node in tree_of(done).items():
        out[top] = (assign(scope.fields.get(top), node, lambda leaf, _: leaf) if isinstance(node, Tree) else node).col
    return base.withColumns(out).drop(*extra, "__sd_rn", *[f"__sd_x{i}" for i in range(len(leaves))], *[f"__sd_f{i}" for i in range(len(leaves))])
