import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkdoc.errors import QueryError, UnsupportedOperator
from sparkdoc.plans.optimize import rewrite
from sparkdoc.plans.pipeline import Context, Flow, execute, extensions, register_stage, run
from sparkdoc.plans import pipeline as engine

D = datetime.datetime


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.createDataFrame([("a", 1, 2.5, ["x", "y"], (1,), D(2024, 1, 1)), ("b", 2, None, [], (2,), D(2024, 1, 2)), ("c", 1, 4.5, None, (3,), D(2024, 1, 4)), ("d", 3, 1.5, ["y"], (4,), D(2024, 1, 8))], "_id string, k int, d double, tags array<string>, m struct<v:int>, t timestamp_ntz")
    f = spark.createDataFrame([("f1", 1, "one"), ("f2", 1, "uno"), ("f3", 9, "nine"), ("f4", None, "none")], "_id string, k int, label string")
    return {"d": d, "f": f}


@pytest.fixture
def go(spark, tables):
    def run_(pipeline, table="d"):
        return [r.asDict(recursive=True) for r in run(pipeline, tables[table], Context(spark, tables.__getitem__)).collect()]

    return run_


def test_ordered_accumulators(go):
    (one, *_) = go([{"$group": {"_id": "$k", "f": {"$first": "$_id"}, "l": {"$last": "$_id"}, "p": {"$push": "$d"}, "b": {"$bottomN": {"n": 2, "sortBy": {"d": 1}, "output": "$_id"}}}}, {"$sort": {"_id": 1}}])
    assert one == {"_id": 1, "f": "a", "l": "c", "p": [2.5, 4.5], "b": ["a", "c"]}
    rows = go([{"$sort": {"d": -1}}, {"$group": {"_id": None, "p": {"$push": "$d"}, "f": {"$first": "$_id"}}}])
    assert rows == [{"_id": None, "p": [4.5, 2.5, 1.5, None], "f": "c"}]


def test_ties_keep_the_first_document(go):
    rows = go([{"$group": {"_id": None, "t": {"$top": {"sortBy": {"k": 1}, "output": "$_id"}}, "b": {"$bottom": {"sortBy": {"k": -1}, "output": "$_id"}}}}])
    assert rows == [{"_id": None, "t": "a", "b": "a"}]


def test_buckets(go):
    assert go([{"$bucket": {"groupBy": "$k", "boundaries": [0, 1, 2], "default": 9}}]) == [{"_id": 0, "count": 0}, {"_id": 1, "count": 2}, {"_id": 9, "count": 2}]
    assert go([{"$bucketAuto": {"groupBy": "$k", "buckets": 3}}]) == [{"_id": {"min": 1, "max": 2}, "count": 2}, {"_id": {"min": 2, "max": 3}, "count": 1}, {"_id": {"min": 3, "max": 3}, "count": 1}]


def test_empty_input(go):
    none = {"$match": {"k": 99}}
    assert go([none, {"$count": "n"}]) == [{"n": 0}]
    assert go([none, {"$group": {"_id": None, "n": {"$sum": 1}}}]) == []


def test_lookup_forms(go):
    assert [len(r["j"]) for r in go([{"$sort": {"_id": 1}}, {"$lookup": {"from": "f", "localField": "k", "foreignField": "k", "as": "j"}}, {"$sort": {"_id": 1}}])] == [2, 0, 2, 0]
    rows = go([{"$lookup": {"from": "d", "localField": "nothing", "foreignField": "nothing", "as": "j"}}, {"$project": {"n": {"$size": "$j"}}}], "f")
    assert {r["n"] for r in rows} == {4}  # missing joins missing
    rows = go([{"$lookup": {"from": "f", "let": {"kk": "$k"}, "pipeline": [{"$match": {"$expr": {"$gt": ["$k", "$$kk"]}}}, {"$sort": {"label": -1}}, {"$limit": 1}, {"$project": {"_id": 0, "label": 1, "kk": "$$kk"}}], "as": "j"}}, {"$sort": {"_id": 1}}])
    assert [r["j"] for r in rows] == [[{"label": "nine", "kk": k}] for k in (1, 2, 1, 3)]
    rows = go([{"$lookup": {"from": "f", "localField": "tags", "foreignField": "label", "as": "j"}}, {"$project": {"n": {"$size": "$j"}}}])
    assert {r["n"] for r in rows} == {0}


@pytest.mark.parametrize("after", [[{"$unwind": "$j"}, {"$project": {"_id": 1, "l": "$j.label"}}], [{"$unwind": {"path": "$j", "preserveNullAndEmptyArrays": True}}, {"$project": {"_id": 1, "l": "$j.label"}}], [{"$match": {"j": []}}, {"$unset": "j"}], [{"$match": {"j": {"$ne": []}}}, {"$project": {"_id": 1}}]])
def test_rewrites_change_nothing(spark, tables, after, monkeypatch):
    pipeline = [{"$lookup": {"from": "f", "localField": "k", "foreignField": "k", "as": "j"}}, *after]
    assert rewrite(pipeline) != pipeline
    context = Context(spark, tables.__getitem__)
    fast = sorted(map(repr, run(pipeline, tables["d"], context).collect()))
    flow = Flow(tables["d"], context)
    for spec in pipeline:
        ((name, body),) = spec.items()
        flow = engine.stages[name](flow, body, False)
    assert fast == sorted(map(repr, flow.df.collect()))


def test_fused_joins_collect_nothing(spark, tables):
    plan = run([{"$lookup": {"from": "f", "localField": "k", "foreignField": "k", "as": "j"}}, {"$unwind": "$j"}], tables["d"], Context(spark, tables.__getitem__))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Python" not in plan


def test_windows(go):
    rows = go([{"$setWindowFields": {"partitionBy": "$k", "sortBy": {"t": 1}, "output": {"r": {"$rank": {}}, "s": {"$sum": "$d", "window": {"documents": ["unbounded", "current"]}}, "x.e": {"$expMovingAvg": {"input": "$d", "N": 2}}, "sh": {"$shift": {"output": "$_id", "by": -1, "default": "none"}}, "dv": {"$derivative": {"input": "$d", "unit": "day"}}, "it": {"$integral": {"input": "$d", "unit": "day"}}}}}, {"$match": {"k": 1}}, {"$sort": {"t": 1}}])
    a, c = rows
    assert (a["r"], a["s"], a["x"], a["sh"]) == (1, 2.5, {"e": 2.5}, "none")
    assert (c["r"], c["s"], c["sh"], c["it"]) == (2, 7.0, "a", 10.5)
    assert c["dv"] == pytest.approx(2 / 3) and c["x"]["e"] == pytest.approx(23 / 6)


def test_densify_and_fill(go):
    rows = go([{"$densify": {"field": "t", "range": {"step": 2, "unit": "day", "bounds": "full"}}}, {"$sort": {"t": 1}}])
    assert [(r["_id"], r["t"].day) for r in rows] == [("a", 1), (None, 3), (None, 5), (None, 7)]
    rows = go([{"$fill": {"sortBy": {"t": 1}, "output": {"d": {"method": "linear"}, "tags": {"value": ["z"]}}}}, {"$sort": {"t": 1}}])
    assert [r["d"] for r in rows] == [2.5, 3.5, 4.5, 1.5] and rows[2]["tags"] == ["z"]


def test_shapes(go):
    assert go([{"$project": {"_id": 0, "x": "$m.v", "n": {"z": "$k"}}}, {"$limit": 1}]) == [{"x": 1, "n": {"z": 1}}]
    assert set(go([{"$unset": ["m.v", "k", "d"]}])[0]) == {"_id", "tags", "t"}
    assert go([{"$replaceWith": "$m"}, {"$sort": {"v": -1}}, {"$limit": 1}]) == [{"v": 4}]
    rows = go([{"$redact": {"$cond": [{"$gt": ["$v", 2]}, "$$PRUNE", "$$DESCEND"]}}, {"$sort": {"_id": 1}}])
    assert [r["m"] for r in rows] == [{"v": 1}, {"v": 2}, None, None]
    rows = go([{"$unwind": {"path": "$tags", "includeArrayIndex": "i", "preserveNullAndEmptyArrays": True}}, {"$sort": {"_id": 1, "i": 1}}])
    assert [(r["_id"], r["tags"], r["i"]) for r in rows] == [("a", "x", 0), ("a", "y", 1), ("b", None, None), ("c", None, None), ("d", "y", 0)]


def test_facets_and_unions(go):
    assert go([{"$facet": {"a": [{"$match": {"k": 1}}, {"$project": {"_id": 1}}], "b": [{"$count": "n"}]}}]) == [{"a": [{"_id": "a"}, {"_id": "c"}], "b": [{"n": 4}]}]
    assert len(go([{"$unionWith": {"coll": "f", "pipeline": [{"$match": {"k": 1}}]}}])) == 6
    assert go([{"$documents": [{"a": 1}, {"a": 2.5}]}]) == [{"a": 1.0}, {"a": 2.5}]


def test_errors(go):
    for pipeline in ([{"$out": "x"}], [{"$graphLookup": {}}], [{"$semiLookup": {}}]):
        with pytest.raises(UnsupportedOperator):
            go(pipeline)
    for pipeline in ([{"$limit": -1}], [{"$match": {}}, {"$documents": []}], [{"$sort": {"a": 2}}], [{"$project": {"a": 1, "b": 0}}], [{"$group": {"x": {"$sum": 1}}}], [{"$merge": "x"}, {"$limit": 1}]):
        with pytest.raises(QueryError):
            go(pipeline)


def test_own_stage(go):
    register_stage("$every", lambda df, spec: df.where(f"k % {spec} = 0"))
    assert [r["_id"] for r in go([{"$every": 2}])] == ["b"]
    del extensions["$every"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=12), st.integers(0, 4), st.integers(0, 6))
def test_sort_skip_limit_against_python(spark, values, lo, n):
    df = spark.createDataFrame(list(enumerate(values)), "_id long, v long")
    rows = run([{"$sort": {"v": 1}}, {"$skip": lo}, {"$limit": n}], df, Context(spark, lambda _: df)).collect()
    assert [r._id for r in rows] == [i for i, _ in sorted(enumerate(values), key=lambda x: x[1])][lo : lo + n]


def test_execute_needs_a_list(spark, tables):
    with pytest.raises(QueryError):
        execute({"$match": {}}, Flow(tables["d"], Context(spark, tables.__getitem__)))


def test_moving_average_over_whole_partitions(spark):
    n, alpha = 30_000, 0.25
    rows = [(i, None if i % 11 == 0 else i % 3, None if i % 7 == 0 else float(i * 37 % 101)) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, g long, v double").repartition(6)
    stage = {"$setWindowFields": {"partitionBy": "$g", "sortBy": {"i": 1}, "output": {"x": {"$expMovingAvg": {"input": "$v", "alpha": alpha}}, "y": {"$expMovingAvg": {"input": "$i", "N": 3}}}}}
    got_df = run([stage, {"$project": {"i": 1, "x": 1, "y": 1}}], df, Context(spark, {}.__getitem__))
    assert "collect_list" not in got_df._jdf.queryExecution().optimizedPlan().toString()
    got, state = {r.i: (r.x, r.y) for r in got_df.collect()}, {}
    assert len(got) == n
    for i, g, v in rows:
        x, y = state.get(g, (None, None))
        x = x if v is None else v if x is None else v * alpha + x * (1 - alpha)
        y = float(i) if y is None else i * 0.5 + y * 0.5
        state[g] = x, y
        assert got[i] == state[g]
