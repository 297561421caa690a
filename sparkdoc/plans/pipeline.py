"""Aggregation pipelines: a list of stages becomes one DataFrame plan.

Stages are functions from a Flow to a Flow; nothing runs before the caller asks for rows, so Catalyst sees a whole
pipeline at once and pushes its filters and columns into the scan. A Flow also knows the document order, as hidden
columns, if a later stage observes it, and the hidden columns within whose values sub-pipelines of `$lookup` run.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedOperator
from ..functions.core import LONG, REMOVE, E, Scope, compile_expression, concrete_type, hidden, less, literal, named, quote, resolve, value
from ..operators import accumulators as acc
from ..operators import fill as fills
from ..operators import geo
from ..operators.filters import compile_filter
from ..operators.ordering import ORDINAL, Key, Order, order_by, sortable
from ..operators.shapes import Tree, assign, concrete, exclude, include, tree_of
from ..operators.shapes import new as shapes_new
from ..operators.windows import set_window_fields


@dataclass
class Context:
    """What a pipeline can refer to: other collections, variables, the clock, and sources of metadata rows."""

    spark: SparkSession
    collection: Callable[[str], DataFrame]
    variables: dict[str, E] = field(default_factory=dict)
    now: datetime.datetime = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
    metadata: Callable[[str, Any], DataFrame] | None = None
    search: Callable[[str, Any, DataFrame], DataFrame] | None = None
    text_paths: tuple[str, ...] = ()
    text_weights: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    context: Context
    ties: tuple[Key, ...] = ()
    within: tuple[str, ...] = ()
    ordered: bool = False  # the rows lie in the order of `ties`

    @property
    def scope(self) -> Scope:
        return replace(Scope.of(self.df.schema, self.context.variables), now=self.context.now)

    def carried(self) -> list[Column]:
        return [F.col(quote(c)) for c in self.df.columns if hidden(c)]

    def on(self, df: DataFrame, **changes: Any) -> Flow:
        return replace(self, df=df, **changes)

    def parts(self) -> list[Column]:
        return [F.col(quote(c)) for c in self.within]


Stage = Callable[[Flow, Any, bool], Flow]
stages: dict[str, Stage] = {}
extensions: dict[str, Callable[[DataFrame, Any], DataFrame]] = {}


def stage(*names: str) -> Callable[[Stage], Stage]:
    def enter(handler: Stage) -> Stage:
        for name in names:
            stages[name] = handler
        return handler

    return enter


def register_stage(name: str, handler: Callable[[DataFrame, Any], DataFrame]) -> None:
    """A stage of the user's: a function from a DataFrame and the stage's specification to a DataFrame."""
    if not name.startswith("$") or name in stages:
        raise QueryError(f"{name} cannot be registered")
    extensions[name] = handler


def single(spec: Any) -> tuple[str, Any]:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise QueryError("a stage is an object with one operator")
    return next(iter(spec.items()))


def observes_order(pipeline: list) -> bool:
    """Whether a stage's result depends on the order that documents come in."""
    for spec in pipeline:
        name, body = single(spec)
        if name in ("$skip", "$limit", "$bucketAuto", "$setWindowFields", "$densify", "$fill", "$sort"):
            return True
        if name in ("$group", "$bucket") and isinstance(body, dict):
            outputs = body.get("output") or {k: v for k, v in body.items() if k != "_id"}
            if any(isinstance(v, dict) and set(v) & acc.ORDERED for v in outputs.values()):
                return True
        if name == "$facet" and isinstance(body, dict) and any(observes_order(p) for p in body.values()):
            return True
        if name in ("$group", "$bucket", "$sortByCount", "$count", "$facet"):
            return False
    return False


def run(pipeline: list, df: DataFrame, context: Context) -> DataFrame:
    """The documents that a pipeline makes of df, hidden columns removed."""
    flow = execute(pipeline, Flow(df, context))
    return flow.df.drop(*[c for c in flow.df.columns if hidden(c)])


def execute(pipeline: list, flow: Flow) -> Flow:
    from .optimize import rewrite

    if not isinstance(pipeline, list):
        raise QueryError("a pipeline is a list of stages")
    for position, spec in enumerate(pipeline):
        check_position(single(spec)[0], position, len(pipeline))
        if single(spec)[0] == "$semiLookup":
            raise UnsupportedOperator("aggregation stage", "$semiLookup")
    todo = rewrite(pipeline)
    if not flow.ties and observes_order(todo) and not single(todo[0])[0].startswith(("$search", "$vectorSearch", "$documents")):
        flow = flow.on(flow.df.withColumn(ORDINAL, F.monotonically_increasing_id()), ties=(Key(ORDINAL, LONG),), ordered=not flow.within)
    for k, spec in enumerate(todo):
        name, body = single(spec)
        if flow.within and name in NOT_WITHIN:
            raise QueryError(f"{name} is not supported in the pipeline of a correlated $lookup")
        if name in stages:
            flow = stages[name](flow, body, observes_order(todo[k + 1 :]))
        elif name in extensions:
            flow = flow.on(extensions[name](flow.df, body))
        else:
            raise UnsupportedOperator("aggregation stage", name)
    return flow


#: Stages that cannot run for each combination of a lookup's variables.
NOT_WITHIN = ("$bucket", "$facet", "$densify", "$fill", "$sample", "$geoNear", "$unionWith")

FIRST = ("$documents", "$search", "$searchMeta", "$vectorSearch", "$geoNear", "$collStats", "$indexStats", "$currentOp", "$planCacheStats", "$listSessions")


def check_position(name: str, position: int, length: int) -> None:
    if name in FIRST and position:
        raise QueryError(f"{name} is a first stage")
    if name == "$merge" and position != length - 1:
        raise QueryError("$merge is a last stage")


# --- one document at a time ------------------------------------------------------------------------------------------


@stage("$match")
def match(flow: Flow, spec: Any, observed: bool) -> Flow:
    if isinstance(spec, dict) and "$text" in spec:
        from ..operators.search import classic_text

        rest = {k: v for k, v in spec.items() if k != "$text"}
        flow = flow.on(classic_text(flow.df, spec["$text"], flow.context.text_paths, flow.context.text_weights))
        spec = rest
    return flow.on(flow.df.where(compile_filter(spec, flow.scope))) if spec else flow


def flatten(spec: dict, prefix: str = "") -> dict[str, Any]:
    """{"a": {"b": 1}} as {"a.b": 1}; expression objects stay."""
    out: dict[str, Any] = {}
    for k, v in spec.items():
        if isinstance(v, dict) and v and not any(x.startswith("$") for x in v):
            out |= flatten(v, f"{prefix}{k}.")
        else:
            out[prefix + k] = v
    return out


def is_flag(x: Any) -> bool:
    return isinstance(x, bool | int | float)


def select(flow: Flow, fields: dict[str, E]) -> DataFrame:
    return flow.df.select(*[concrete(e).col.alias(n) for n, e in fields.items()], *flow.carried())


@stage("$project")
def project(flow: Flow, spec: Any, observed: bool) -> Flow:
    if not isinstance(spec, dict) or not spec:
        raise QueryError("$project takes a non-empty object")
    paths, scope = flatten(spec), flow.scope
    flags = {p: bool(v) for p, v in paths.items() if is_flag(v)}
    others = {p: v for p, v in flags.items() if p != "_id"}
    if others and not all(others.values()) and (any(others.values()) or len(flags) < len(paths)):
        raise QueryError("$project includes or excludes fields, not both")
    visible = {n: e for n, e in scope.fields.items() if not hidden(n)}
    if (others and not any(others.values())) or (not others and len(paths) == len(flags) and not flags.get("_id", True)):
        gone = tree_of({p: 1 for p, v in flags.items() if not v})
        kept = {n: (exclude(e, gone[n]) if isinstance(gone.get(n), Tree) else e) for n, e in visible.items() if n not in gone or isinstance(gone[n], Tree)}
        return flow.on(select(flow, {n: e for n, e in kept.items() if e is not None}))
    if paths.get("_id", True) is not False and paths.get("_id", 1) != 0 and "_id" not in paths and "_id" in visible:
        paths = {"_id": True} | paths
    paths = {p: v for p, v in paths.items() if not (is_flag(v) and not v)}

    def make(leaf: Any, own: E | None) -> Any:
        return own if is_flag(leaf) else compile_expression(leaf, scope)

    out: dict[str, E] = {}
    for name, node in tree_of(paths).items():
        own = visible.get(name)
        if isinstance(node, Tree):
            made = include(own, node, make) if own is not None else shapes_new(node, make)
        else:
            made = make(node, own)
        if made is not None and made is not REMOVE:
            out[name] = made
    order = [n for n in visible if n in out and is_kept(paths, n)] + [n for n in out if not (n in visible and is_kept(paths, n))]
    return flow.on(select(flow, {n: out[n] for n in order}))


def is_kept(paths: dict[str, Any], name: str) -> bool:
    return is_flag(paths.get(name)) or any(p.startswith(name + ".") for p in paths)


@stage("$addFields", "$set")
def add_fields(flow: Flow, spec: Any, observed: bool) -> Flow:
    if not isinstance(spec, dict) or not spec:
        raise QueryError("$addFields takes a non-empty object")
    scope = flow.scope

    def make(leaf: Any, own: E | None) -> Any:
        return compile_expression(leaf, scope)

    out: dict[str, Any] = {}
    for name, node in tree_of(flatten(spec)).items():
        out[name] = assign(scope.fields.get(name), node, make) if isinstance(node, Tree) else make(node, None)
    gone = [n for n, e in out.items() if e is REMOVE]
    return flow.on(flow.df.withColumns({n: concrete(e).col for n, e in out.items() if e is not REMOVE}).drop(*gone))


@stage("$unset")
def unset(flow: Flow, spec: Any, observed: bool) -> Flow:
    names = [spec] if isinstance(spec, str) else spec
    if not isinstance(names, list) or not names or not all(isinstance(n, str) and n for n in names):
        raise QueryError("$unset takes a path or a list of paths")
    return project(flow, dict.fromkeys(names, 0), observed)


@stage("$replaceRoot")
def replace_root(flow: Flow, spec: Any, observed: bool) -> Flow:
    return replace_with(flow, named(spec, "$replaceRoot", ("newRoot",))["newRoot"], observed)


@stage("$replaceWith")
def replace_with(flow: Flow, spec: Any, observed: bool) -> Flow:
    e = value(spec, flow.scope)
    if not isinstance(e.type, T.StructType):
        raise QueryError("the new root has to be an object")
    checked = flow.df.withColumn("__sd_root", F.when(e.col.isNull(), F.raise_error(F.lit("the new root has to be an object"))).otherwise(e.col))
    root = flow.on(checked)
    return flow.on(checked.select(F.col("__sd_root.*"), *root.carried()).drop("__sd_root"))


@stage("$redact")
def redact(flow: Flow, spec: Any, observed: bool) -> Flow:
    scope = flow.scope.bind(KEEP=literal("KEEP"), PRUNE=literal("PRUNE"), DESCEND=literal("DESCEND"))

    def cut(e: E) -> Column:
        """The document after redaction, null if it is pruned."""
        fields = {f.name: E(e.col.getField(f.name), f.dataType) for f in e.type.fields}
        verdict = value(spec, replace(scope, fields=fields).bind(CURRENT=e)).col
        parts = []
        for name, own in fields.items():
            inner = own.type
            if isinstance(inner, T.StructType):
                parts.append(F.when(own.col.isNotNull(), cut(own)).alias(name))
            elif isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType):
                parts.append(F.filter(F.transform(own.col, lambda x, t=inner.elementType: cut(E(x, t))), lambda x: x.isNotNull()).alias(name))
            else:
                parts.append(own.col.alias(name))
        return F.when(verdict == "KEEP", e.col).when(verdict == "DESCEND", F.struct(*parts)).when(verdict == "PRUNE", F.lit(None)).otherwise(F.raise_error(F.lit("$redact needs $$KEEP, $$PRUNE or $$DESCEND")))

    root = flow.scope.root()
    done = flow.df.withColumn("__sd_root", root.col)
    done = done.withColumn("__sd_root", cut(E(F.col("__sd_root"), root.type))).where(F.col("__sd_root").isNotNull())
    return flow.on(done.select(F.col("__sd_root.*"), *flow.carried()))


@stage("$unwind")
def unwind(flow: Flow, spec: Any, observed: bool) -> Flow:
    if isinstance(spec, str):
        spec = {"path": spec}
    named(spec, "$unwind", ("path",), ("includeArrayIndex", "preserveNullAndEmptyArrays"))
    path, index, keep = spec["path"], spec.get("includeArrayIndex"), bool(spec.get("preserveNullAndEmptyArrays", False))
    if not isinstance(path, str) or not path.startswith("$"):
        raise QueryError("$unwind takes a path that starts with $")
    path = path[1:]
    e = resolve(flow.scope, path)
    number = f"__sd_u{sum(k.name.startswith('__sd_u') for k in flow.ties)}"
    if isinstance(e.type, T.ArrayType):
        # the position is asked for only where somebody sees it
        if index or observed:
            exploded = flow.df.select("*", (F.posexplode_outer if keep else F.posexplode)(e.col).alias(number, "__sd_item"))
        else:
            exploded = flow.df.select("*", (F.explode_outer if keep else F.explode)(e.col).alias("__sd_item"))
        item, at = E(F.col("__sd_item"), e.type.elementType), F.col(number).cast(LONG) if index or observed else None
    else:
        exploded = flow.df.withColumn("__sd_item", concrete(e).col)
        exploded = exploded if keep else exploded.where(F.col("__sd_item").isNotNull())
        item, at = E(F.col("__sd_item"), e.type), F.lit(None).cast(LONG)
    scope = Scope.of(exploded.schema, flow.context.variables)
    out: dict[str, E] = {}
    leaves = {path: item} | ({index: E(at, LONG)} if index else {})
    for name, node in tree_of(leaves).items():
        out[name] = assign(scope.fields.get(name), node, lambda leaf, _: leaf) if isinstance(node, Tree) else node
    done = exploded.withColumns({n: concrete(x).col for n, x in out.items()}).drop("__sd_item")
    if observed and isinstance(e.type, T.ArrayType):
        return flow.on(done, ties=(*flow.ties, Key(number, T.IntegerType())))
    return flow.on(done.drop(number) if isinstance(e.type, T.ArrayType) and number in done.columns else done)


# --- groups ----------------------------------------------------------------------------------------------------------


def grouped(flow: Flow, keys: dict[str, Column], output: dict[str, tuple[str, acc.Compiled]], observed: bool) -> DataFrame:
    """Aggregates by hidden key columns, with only the operands and the order carried into the shuffle."""
    inputs = {n: e.col for _, c in output.values() for n, e in c.inputs.items()}
    needs_order = any(op in acc.ORDERED for op, _ in output.values())
    order_columns = [F.col(quote(k.name)) for k in flow.ties] if needs_order or observed else []
    narrow = flow.df.select(*[c.alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in inputs.items()], *flow.parts(), *order_columns)
    order = Order(list(flow.ties) if needs_order else [])
    aggregates = [c.build(order, None).alias(n) for n, (_, c) in output.items()]
    if observed and len(flow.ties) >= 1:
        aggregates.append(F.min(F.col(quote(flow.ties[0].name))).alias("__sd_first"))
    return narrow.groupBy(*flow.parts(), *keys).agg(*(aggregates or [F.lit(0).alias("__sd_none")]))


def after_group(flow: Flow, df: DataFrame) -> Flow:
    """Groups come in the order of their first documents."""
    if "__sd_first" in df.columns:
        first = flow.ties[0]
        return flow.on(df.drop("__sd_none"), ties=(Key("__sd_first", first.type, first.ascending),), ordered=False)
    return flow.on(df.drop("__sd_none"), ties=(), ordered=False)


@stage("$group")
def group(flow: Flow, spec: Any, observed: bool) -> Flow:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise QueryError("$group needs an _id")
    scope, key = flow.scope, spec["_id"]
    output = acc.compile_output({k: v for k, v in spec.items() if k != "_id"}, scope, "$group")
    if isinstance(key, dict) and key and not any(k.startswith("$") for k in key):
        fields = {n: concrete(value(v, scope)) for n, v in key.items()}
        keys = {f"__sd_g{i}": e.col for i, e in enumerate(fields.values())}
        made = grouped(flow, keys, output, observed)
        out = F.struct(*[F.col(k).alias(n) for k, n in zip(keys, fields, strict=True)])
    else:
        e = concrete(value(key, scope))
        constant_key = key is None
        keys = {"__sd_g0": F.lit(0) if constant_key else e.col}
        made = grouped(flow, keys, output, observed)
        out = F.lit(None).cast(e.type) if constant_key else F.col("__sd_g0")
    rest = [F.col(quote(c)) for c in made.columns if c not in keys]
    return after_group(flow, made.select(out.alias("_id"), *rest))


@stage("$sortByCount")
def sort_by_count(flow: Flow, spec: Any, observed: bool) -> Flow:
    counted = group(flow, {"_id": spec, "count": {"$sum": 1}}, False)
    return sort(counted, {"count": -1, "_id": 1}, observed)


@stage("$count")
def count(flow: Flow, spec: Any, observed: bool) -> Flow:
    if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
        raise QueryError("$count takes a field name")
    if flow.within:
        return flow.on(flow.df.groupBy(*flow.parts()).agg(F.count(F.lit(1)).alias(spec)), ties=(), ordered=False)
    return flow.on(flow.df.agg(F.count(F.lit(1)).alias(spec)), ties=(), ordered=False)


@stage("$bucket")
def bucket(flow: Flow, spec: Any, observed: bool) -> Flow:
    named(spec, "$bucket", ("groupBy", "boundaries"), ("default", "output"))
    bounds = spec["boundaries"]
    if not isinstance(bounds, list) or len(bounds) < 2 or any(not (a < b) for a, b in zip(bounds, bounds[1:], strict=False)):
        raise QueryError("$bucket takes at least two strictly increasing boundaries")
    scope = flow.scope
    e = value(spec["groupBy"], scope)
    chain = F
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        inside = ~less(e, literal(lo)) & less(e, literal(hi))
        chain = chain.when(inside, F.lit(i))
    outside = F.lit(len(bounds) - 1) if "default" in spec else F.raise_error(F.lit("$bucket found a document outside of its boundaries")).cast("int")
    output = acc.compile_output(spec.get("output") or {"count": {"$sum": 1}}, scope, "$bucket")
    made = grouped(flow, {"__sd_b": chain.otherwise(outside)}, output, False)
    # every bucket is there, be it empty: the few boundaries are the outer side of the join
    labels = bounds[:-1] + ([spec["default"]] if "default" in spec else [])
    kind = literal(labels).type.elementType if len({literal(x).type.typeName() for x in labels}) == 1 or all(isinstance(x, int | float) for x in labels) else None
    ids = [literal(x).col.cast(kind) if kind else F.lit(str(x)) for x in labels]
    frame = flow.context.spark.range(1).select(F.posexplode(F.array(*ids)).alias("__sd_n", "_id"))
    joined = frame.join(made, F.col("__sd_n") == F.col("__sd_b"), "left")
    fields = [(F.when(F.col("__sd_b").isNull(), c.empty).otherwise(F.col(quote(n))) if c.empty is not None else F.col(quote(n))).alias(n) for n, (_, c) in output.items()]
    return flow.on(joined.select("_id", *fields, "__sd_n").orderBy("__sd_n"), ties=(Key("__sd_n", T.IntegerType()),), ordered=True)


@stage("$bucketAuto")
def bucket_auto(flow: Flow, spec: Any, observed: bool) -> Flow:
    """Equal numbers of documents a bucket, by position alone: `ntile` over a total order, then one group a tile."""
    named(spec, "$bucketAuto", ("groupBy", "buckets"), ("output",))
    n = spec["buckets"]
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise QueryError("$bucketAuto takes a positive number of buckets")
    scope = flow.scope
    e = concrete(value(spec["groupBy"], scope))
    output = acc.compile_output(spec.get("output") or {"count": {"$sum": 1}}, scope, "$bucketAuto")
    key = Key("__sd_key", e.type)
    keyed = flow.df.withColumn("__sd_key", e.col)
    keyed = keyed.withColumn("__sd_tile", F.ntile(n).over(Window.partitionBy(*flow.parts()).orderBy(*order_by(key), *[c for k in flow.ties for c in order_by(k)])))
    tiled = flow.on(keyed)
    made = grouped(tiled, {"__sd_tile": F.col("__sd_tile")}, output | {"__sd_min": ("$min", acc.Compiled(e.type, lambda order, over: F.min("__sd_lo"), {"__sd_lo": E(F.col("__sd_key"), e.type)})), "__sd_max": ("$max", acc.Compiled(e.type, lambda order, over: F.max("__sd_hi"), {"__sd_hi": E(F.col("__sd_key"), e.type)}))}, False)
    upper = F.coalesce(F.lead("__sd_min").over(Window.partitionBy(*flow.parts()).orderBy("__sd_tile")), F.col("__sd_max"))
    done = made.withColumn("_id", F.struct(F.col("__sd_min").alias("min"), upper.alias("max")))
    return flow.on(done.select("_id", *[F.col(quote(c)) for c in output], "__sd_tile", *flow.parts()), ties=(Key("__sd_tile", T.IntegerType()),), ordered=False)


@stage("$setWindowFields")
def window_fields(flow: Flow, spec: Any, observed: bool) -> Flow:
    return flow.on(set_window_fields(flow.df, spec, flow.scope, list(flow.ties), flow.within), ordered=False)


@stage("$densify")
def densify(flow: Flow, spec: Any, observed: bool) -> Flow:
    return flow.on(fills.densify(flow.df, spec, flow.scope, list(flow.ties)), ordered=False)


@stage("$fill")
def fill(flow: Flow, spec: Any, observed: bool) -> Flow:
    return flow.on(fills.fill(flow.df, spec, flow.scope, list(flow.ties)), ordered=False)


# --- order -----------------------------------------------------------------------------------------------------------


@stage("$sort")
def sort(flow: Flow, spec: Any, observed: bool) -> Flow:
    if not isinstance(spec, dict) or not spec:
        raise QueryError("$sort takes a non-empty object")
    scope, keys, extra = flow.scope, [], {}
    for i, (path, direction) in enumerate(spec.items()):
        if isinstance(direction, dict) and list(direction) == ["$meta"]:
            e, ascending = value(direction, scope), False
        elif direction in (1, -1) and not isinstance(direction, bool):
            e, ascending = sortable(concrete(resolve(scope, path)), direction == 1), direction == 1
        else:
            raise QueryError("$sort takes 1 or -1")
        name = f"__sd_s{i}"
        extra[name] = e.col
        keys.append(Key(name, concrete_type(e.type), ascending))
    ties = tuple(k for k in flow.ties if k.name not in extra)
    df = flow.df.drop(*[n for n in extra if n in flow.df.columns and not any(k.name == n for k in flow.ties)])
    if any(k.name in extra for k in flow.ties):  # sorted before: those keys break ties under other names
        renames = {k.name: f"__sd_t{j}_{k.name[5:]}" for j, k in enumerate(flow.ties) if k.name in extra}
        df = df.withColumnsRenamed(renames)
        ties = tuple(Key(renames.get(k.name, k.name), k.type, k.ascending) for k in flow.ties)
    df = df.withColumns(extra)
    all_keys = (*keys, *ties)
    if flow.within:
        return flow.on(df, ties=all_keys, ordered=False)
    return flow.on(df.orderBy(*[c for k in all_keys for c in order_by(k)]), ties=all_keys, ordered=True)


def positioned(flow: Flow) -> Flow:
    """Rows in document order."""
    if flow.ordered or not flow.ties:
        return flow
    return flow.on(flow.df.orderBy(*[c for k in flow.ties for c in order_by(k)]), ordered=True)


def whole(spec: Any, name: str) -> int:
    if not isinstance(spec, int) or isinstance(spec, bool) or spec < 0:
        raise QueryError(f"{name} takes a whole number of at least 0")
    return spec


def _window(flow: Flow, lo: int, hi: int | None) -> Flow:
    """Rows lo (exclusive) to hi of each part that a sub-pipeline runs within."""
    number = F.row_number().over(Window.partitionBy(*flow.parts()).orderBy(*[c for k in flow.ties for c in order_by(k)] or [F.lit(0)]))
    df = flow.df.withColumn("__sd_row", number).where((F.col("__sd_row") > lo) & (F.col("__sd_row") <= hi if hi is not None else F.lit(True)))
    return flow.on(df.drop("__sd_row"))


@stage("$skip")
def skip(flow: Flow, spec: Any, observed: bool) -> Flow:
    n = whole(spec, "$skip")
    if flow.within:
        return _window(flow, n, None)
    at = positioned(flow)
    return at.on(at.df.offset(n))


@stage("$limit")
def limit(flow: Flow, spec: Any, observed: bool) -> Flow:
    n = whole(spec, "$limit")
    if flow.within:
        return _window(flow, 0, n)
    at = positioned(flow)
    return at.on(at.df.limit(n))


@stage("$sample")
def sample(flow: Flow, spec: Any, observed: bool) -> Flow:
    n = whole(named(spec, "$sample", ("size",))["size"], "$sample")
    return flow.on(flow.df.orderBy(F.rand()).limit(n), ordered=False)


@stage("$geoNear")
def geo_near(flow: Flow, spec: Any, observed: bool) -> Flow:
    named(spec, "$geoNear", ("near", "key", "distanceField"), ("query", "minDistance", "maxDistance", "includeLocs", "spherical", "distanceMultiplier"))
    e = resolve(flow.scope, spec["key"])
    found = geo.distance(e, geo.coordinates(spec["near"], "$geoNear"))
    df = flow.df.where(compile_filter(spec["query"], flow.scope)) if spec.get("query") else flow.df
    df = df.withColumn("__sd_d", found).where(F.col("__sd_d").isNotNull())
    for name, test in (("minDistance", lambda d, x: d >= x), ("maxDistance", lambda d, x: d <= x)):
        if spec.get(name) is not None:
            df = df.where(test(F.col("__sd_d"), float(spec[name])))
    new: dict[str, Any] = {spec["distanceField"]: E(F.col("__sd_d") * float(spec.get("distanceMultiplier", 1.0)), T.DoubleType())}
    if spec.get("includeLocs"):
        new[spec["includeLocs"]] = e
    scope = Scope.of(df.schema, flow.context.variables)
    out = {n: (assign(scope.fields.get(n), x, lambda leaf, _: leaf) if isinstance(x, Tree) else x).col for n, x in tree_of(new).items()}
    keys = [Key("__sd_d", T.DoubleType())] + ([Key("_id", scope.fields["_id"].type)] if "_id" in scope.fields else [])
    df = df.withColumns(out).orderBy(*[c for k in keys for c in order_by(k)])
    return flow.on(df, ties=(keys[0],), ordered=True)


# --- sources ---------------------------------------------------------------------------------------------------------


@stage("$documents")
def documents(flow: Flow, spec: Any, observed: bool) -> Flow:
    if not isinstance(spec, list) or not all(isinstance(d, dict) for d in spec):
        raise QueryError("$documents takes a list of objects")
    rows = [value({"$literal": d}, Scope({})) for d in spec]
    one = flow.context.spark.range(1)
    if not rows:
        return flow.on(one.where("false").select(F.lit(None).cast("string").alias("_id")))
    from ..functions.core import cast, common_type

    kind = common_type([r.type for r in rows])
    made = one.select(F.explode(F.array(*[cast(r, kind) for r in rows])).alias("d")).select("d.*")
    return flow.on(made, ties=(), ordered=True)


def _meta(name: str) -> None:
    @stage(name)
    def handler(flow: Flow, spec: Any, observed: bool) -> Flow:
        if flow.context.metadata is None:
            raise QueryError(f"{name} needs a collection")
        return flow.on(flow.context.metadata(name, spec), ties=(), ordered=True)


for _name in ("$collStats", "$indexStats", "$currentOp", "$planCacheStats", "$listSessions"):
    _meta(_name)


def _search(name: str) -> None:
    @stage(name)
    def handler(flow: Flow, spec: Any, observed: bool) -> Flow:
        if flow.context.search is None:
            raise QueryError(f"{name} needs a collection with search indexes")
        made = flow.context.search(name, spec, flow.df)
        keys = tuple(Key(c, made.schema[c].dataType, True) for c in made.columns if c.startswith("__sd_rank"))
        return flow.on(made, ties=keys, ordered=True)


for _name in ("$search", "$searchMeta", "$vectorSearch"):
    _search(_name)


@stage("$merge")
def merge(flow: Flow, spec: Any, observed: bool) -> Flow:
    raise QueryError("$merge runs on a collection")


# joins register themselves
from . import joins  # noqa: E402, F401
