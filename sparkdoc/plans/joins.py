"""`$lookup`, `$unionWith` and `$facet`.

Joins are decorrelated: a `$lookup` never runs its foreign pipeline once a document. With localField the foreign side is
grouped by its key and joined once; with `let` the distinct values of the variables are joined to the foreign side on
the conditions of its leading `$match` (equalities become hash or merge join keys), the rest of the pipeline runs within
each combination of values, and the collected arrays are joined back.
"""

from __future__ import annotations

import itertools
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.core import E, Scope, equal, hidden, named, quote, resolve, struct_of, value
from ..operators.filters import compile_filter
from ..operators.ordering import Order
from ..operators.shapes import Tree, assign, concrete, tree_of
from .pipeline import Flow, execute, single, stage

#: Stages that look at one document at a time: they may run before the join.
LOCAL = {"$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$replaceWith", "$redact"}


_numbers = itertools.count()


def fresh(name: str) -> str:
    """A hidden column's name that no other stage uses: lookups nest."""
    return f"__sd_{name}{next(_numbers)}"


def put(flow: Flow, df: DataFrame, path: str, e: E) -> DataFrame:
    """df with e at a (perhaps nested) path."""
    ((name, node),) = tree_of({path: e}).items()
    scope = Scope.of(df.schema)
    made = assign(scope.fields.get(name), node, lambda leaf, _: leaf) if isinstance(node, Tree) else node
    return df.withColumn(name, made.col)


def foreign_of(flow: Flow, name: Any) -> DataFrame:
    if isinstance(name, dict):
        name = name.get("coll")
    if not isinstance(name, str):
        raise QueryError("$lookup takes a collection's name as from")
    return flow.context.collection(name)


def document(df: DataFrame) -> E:
    return struct_of({f.name: E(F.col(quote(f.name)), f.dataType) for f in df.schema.fields if not hidden(f.name)})


@stage("$lookup")
def lookup(flow: Flow, spec: Any, observed: bool) -> Flow:
    named(spec, "$lookup", ("as",), ("from", "localField", "foreignField", "let", "pipeline", "__unwind"))
    if ("localField" in spec) != ("foreignField" in spec) or not ("localField" in spec or "pipeline" in spec):
        raise QueryError("$lookup takes localField and foreignField, a pipeline, or both")
    foreign = foreign_of(flow, spec["from"])
    pipeline = spec.get("pipeline") or []
    let = {n: concrete(value(v, flow.scope)) for n, v in (spec.get("let") or {}).items()}
    if "localField" in spec and not let:
        return _by_key(flow, spec, foreign, pipeline)
    if let or "localField" in spec:
        return _by_variables(flow, spec, foreign, pipeline, let)
    # nothing correlates: one array for all
    made = execute(pipeline, Flow(foreign, replace(flow.context, variables={})))
    docs = document(made.df)
    array = made.df.agg(F.coalesce(Order(list(made.ties)).list(docs.col), F.array().cast(T.ArrayType(docs.type))).alias("__sd_as"))
    joined = flow.df.join(F.broadcast(array), how="cross")  # the one row of a global aggregate
    return flow.on(put(flow, joined, spec["as"], E(F.col("__sd_as"), T.ArrayType(docs.type))).drop("__sd_as"), ordered=False)


def when_empty(flow: Flow, foreign: DataFrame, pipeline: list, docs: E, variables: dict[str, E]) -> DataFrame | None:
    """What a pipeline makes of no documents, as one row `__sd_none`; None if that is nothing."""
    if not any(single(s)[0] == "$count" for s in pipeline):
        return None
    nothing = {n: E(F.lit(None).cast(e.type), e.type) for n, e in variables.items()}
    made = execute(pipeline, Flow(foreign.where("false"), replace(flow.context, variables=nothing)))
    return made.df.agg(F.coalesce(F.collect_list(document(made.df).col), F.array().cast(T.ArrayType(docs.type))).alias("__sd_none"))


def or_empty(df: DataFrame, array: str, kind: T.DataType, none: DataFrame | None) -> tuple[DataFrame, Column]:
    """(df, the collected array where there is one, else what no documents give)."""
    if none is None:
        return df, F.coalesce(F.col(array), F.array().cast(kind))
    return df.join(F.broadcast(none), how="cross"), F.coalesce(F.col(array), F.col("__sd_none"))  # one row


def _members(e: E) -> tuple[Column, T.DataType, bool]:
    """Keys that a value joins by: an array's distinct members (null if there are none), or the value."""
    if isinstance(e.type, T.ArrayType):
        return F.when(F.size(e.col) > 0, F.array_distinct(e.col)), e.type.elementType, True
    return e.col, e.type, False


def _by_key(flow: Flow, spec: dict, foreign: DataFrame, pipeline: list) -> Flow:
    local = concrete(resolve(flow.scope, spec["localField"]))
    remote = concrete(resolve(Scope.of(foreign.schema), spec["foreignField"]))
    remote_keys, remote_type, many = _members(remote)
    fk_name, lk_name, as_name, doc_name, la_name, lb_name = (fresh(n) for n in ("fk", "lk", "as", "doc", "la", "lb"))
    keyed = foreign.withColumn(fk_name, F.explode_outer(remote_keys) if many else remote_keys)
    made = execute(pipeline, Flow(keyed, replace(flow.context, variables={}), within=(fk_name,))) if pipeline else Flow(keyed, flow.context)
    docs = document(made.df)
    kind = T.ArrayType(docs.type)
    fk = E(F.col(fk_name), remote_type)
    local_keys, local_type, local_many = _members(local)
    unwound = spec.get("__unwind")
    if unwound is not None and not local_many:
        # fused with the $unwind behind it: rows meet rows, nothing is collected
        side = made.df.select(fk_name, docs.col.alias(doc_name))
        left = flow.df.withColumn(lk_name, local_keys)
        joined = left.join(side, equal(E(F.col(lk_name), local_type), fk), "left" if unwound else "inner")
        return flow.on(put(flow, joined, spec["as"], E(F.col(doc_name), docs.type)).drop(doc_name, lk_name, fk_name), ordered=False)
    lists = made.df.groupBy(fk_name).agg(Order(list(made.ties)).list(docs.col).alias(as_name))
    empty = F.array().cast(kind)
    if not local_many:
        left = flow.df.withColumn(lk_name, local_keys)
        joined = left.join(lists, equal(E(F.col(lk_name), local_type), fk), "left")
        joined, array = or_empty(joined, as_name, kind, when_empty(flow, foreign, pipeline, docs, {}))
        done = put(flow, joined, spec["as"], E(array, kind)).drop(as_name, lk_name, fk_name, "__sd_none")
    else:
        # any member may match: the arrays of all members, each foreign document once
        keys = flow.df.select(local.col.alias(la_name)).distinct().withColumn(lk_name, F.explode_outer(F.when(F.size(la_name) > 0, F.array_distinct(la_name))))
        met = keys.join(lists, equal(E(F.col(lk_name), local_type), fk), "left").groupBy(la_name).agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce(as_name, empty)))).alias(as_name))
        left = flow.df.withColumn(lb_name, local.col)
        joined = left.join(met, F.col(lb_name).eqNullSafe(F.col(la_name)), "left")
        done = put(flow, joined, spec["as"], E(F.coalesce(as_name, empty), kind)).drop(as_name, la_name, lb_name)
    if unwound is not None:
        from .pipeline import unwind

        return unwind(flow.on(done, ordered=False), {"path": "$" + spec["as"], "preserveNullAndEmptyArrays": unwound}, False)
    return flow.on(done, ordered=False)


def _by_variables(flow: Flow, spec: dict, foreign: DataFrame, pipeline: list, let: dict[str, E]) -> Flow:
    if "localField" in spec:
        let = let | {"__sd_local": concrete(resolve(flow.scope, spec["localField"]))}
    names = {n: fresh("v") for n in let}
    left = flow.df.withColumns({names[n]: e.col for n, e in let.items()})
    values = left.select(*names.values()).distinct()
    variables = {n: E(F.col(names[n]), e.type) for n, e in let.items()}
    scope = Scope.of(foreign.schema, variables)
    as_name = fresh("as")
    conditions = []
    if "localField" in spec:
        conditions.append(equal(variables["__sd_local"], resolve(scope, spec["foreignField"])))
    rest = list(pipeline)
    while rest and single(rest[0])[0] == "$match" and "$text" not in single(rest[0])[1]:
        conditions.append(compile_filter(single(rest.pop(0))[1], scope))
    on = conditions[0] if conditions else F.lit(True)
    for c in conditions[1:]:
        on = on & c
    met = values.join(foreign, on)
    made = execute(rest, Flow(met, replace(flow.context, variables=variables), within=tuple(names.values()))) if rest else Flow(met, flow.context)
    docs = document(made.df)
    lists = made.df.groupBy(*names.values()).agg(Order(list(made.ties)).list(docs.col).alias(as_name)).withColumnsRenamed({v: f"{v}r" for v in names.values()})
    back = F.lit(True)
    for v in names.values():
        back = back & F.col(v).eqNullSafe(F.col(f"{v}r"))
    joined = left.join(lists, back, "left")
    kind = T.ArrayType(docs.type)
    joined, array = or_empty(joined, as_name, kind, when_empty(flow, foreign, rest, docs, variables))
    done = put(flow, joined, spec["as"], E(array, kind))
    done = done.drop("__sd_none", as_name, *names.values(), *[f"{v}r" for v in names.values()])
    if spec.get("__unwind") is not None:
        from .pipeline import unwind

        return unwind(flow.on(done, ordered=False), {"path": "$" + spec["as"], "preserveNullAndEmptyArrays": spec["__unwind"]}, False)
    return flow.on(done, ordered=False)


@stage("$semiLookup")
def semi_lookup(flow: Flow, spec: Any, observed: bool) -> Flow:
    """Internal: documents with (or without) a match, when nobody looks at the matches."""
    local = concrete(resolve(flow.scope, spec["localField"]))
    foreign = foreign_of(flow, spec["from"])
    remote = concrete(resolve(Scope.of(foreign.schema), spec["foreignField"]))
    remote_keys, remote_type, many = _members(remote)
    keys = foreign.select((F.explode_outer(remote_keys) if many else remote_keys).alias("__sd_fk"))
    if isinstance(local.type, T.ArrayType):
        joined = lookup(flow, {"from": spec["from"], "localField": spec["localField"], "foreignField": spec["foreignField"], "as": "__sd_met"}, observed)
        return joined.on(joined.df.where(F.size("__sd_met") == 0 if spec["anti"] else F.size("__sd_met") > 0).drop("__sd_met"))
    left = flow.df.withColumn("__sd_lk", local.col)
    joined = left.join(keys, equal(E(F.col("__sd_lk"), local.type), E(F.col("__sd_fk"), remote_type)), "left_anti" if spec["anti"] else "left_semi")
    return flow.on(joined.drop("__sd_lk"), ordered=False)


@stage("$unionWith")
def union_with(flow: Flow, spec: Any, observed: bool) -> Flow:
    spec = {"coll": spec} if isinstance(spec, str) else spec
    named(spec, "$unionWith", (), ("coll", "pipeline"))
    if not spec:
        raise QueryError("$unionWith takes a collection or a pipeline")
    visible = [c for c in flow.df.columns if not hidden(c)]
    other = flow.context.collection(spec["coll"]) if "coll" in spec else flow.df.select(*[F.col(quote(c)) for c in visible])
    made = execute(spec.get("pipeline") or [], Flow(other, replace(flow.context, variables={})))
    right = made.df.select(*[F.col(quote(c)) for c in made.df.columns if not hidden(c)])
    left = flow.df.select(*[F.col(quote(c)) for c in visible])
    if observed:
        left, right = (d.withColumns({"__sd_src": F.lit(i), "__sd_ord2": F.monotonically_increasing_id()}) for i, d in enumerate((left, right)))
    joined = left.unionByName(right, allowMissingColumns=True)
    from ..operators.ordering import Key

    return flow.on(joined, ties=(Key("__sd_src", T.IntegerType()), Key("__sd_ord2", T.LongType())) if observed else (), ordered=False)


@stage("$facet")
def facet(flow: Flow, spec: Any, observed: bool) -> Flow:
    if not isinstance(spec, dict) or not spec:
        raise QueryError("$facet takes named pipelines")
    out: DataFrame | None = None
    for name, pipeline in spec.items():
        if any(single(s)[0] in ("$facet", "$merge", "$search", "$searchMeta", "$vectorSearch", "$documents", "$geoNear", "$collStats", "$indexStats") for s in pipeline):
            raise QueryError("a facet's pipeline has no such stage")
        made = execute(pipeline, flow)
        docs = document(made.df)
        row = made.df.agg(F.coalesce(Order(list(made.ties)).list(docs.col), F.array().cast(T.ArrayType(docs.type))).alias(name))
        out = row if out is None else out.join(F.broadcast(row), how="cross")  # one row each
    return flow.on(out, ties=(), ordered=True)
