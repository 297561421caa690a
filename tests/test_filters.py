import datetime
import re

import pytest

from sparkdoc.errors import QueryError, UnsupportedOperator
from sparkdoc.functions.core import Scope
from sparkdoc.operators.filters import compile_filter


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        ("a", "active", None, 8, [("soft", datetime.datetime(2024, 1, 1))], 1.0, [1.0, 1.0]),
        ("b", None, None, 3, [("soft", None)], float("nan"), [5.0, 5.0]),
        ("c", "retired", None, 9, [("hard", datetime.datetime(2024, 1, 2))], -2.0, [0.0, 3.0]),
        ("d", "active", datetime.datetime(2024, 1, 3), 5, [], None, None),
    ]
    return spark.createDataFrame(rows, "_id string, status string, done timestamp_ntz, score int, items array<struct<kind:string,at:timestamp_ntz>>, d double, at array<double>")


def ids(df, spec):
    return "".join(sorted(r._id for r in df.where(compile_filter(spec, Scope.of(df.schema))).collect()))


@pytest.mark.parametrize(("spec", "expected"), [
    ({}, "abcd"),
    ({"status": "active"}, "ad"),
    ({"status": None}, "b"),
    ({"nothing": None}, "abcd"),
    ({"status": {"$ne": "active"}}, "bc"),
    ({"status": {"$nin": ["active", None]}}, "c"),
    ({"score": {"$gt": "x"}}, ""),
    ({"status": {"$gt": 5}}, "acd"),
    ({"d": {"$lt": 0}}, "bcd"),
    ({"d": {"$gt": 0}}, "a"),
    ({"d": {"$gte": -2}}, "ac"),
    ({"$or": [{"status": {"$exists": False}}, {"status": "active"}], "done": None, "score": {"$in": [3, 8]}}, "ab"),
    ({"$nor": [{"status": "retired"}, {"done": {"$ne": None}}]}, "ab"),
    ({"items.at": {"$exists": True, "$ne": None}}, "ac"),
    ({"items": {"$elemMatch": {"kind": "soft", "at": {"$gt": datetime.datetime(2023, 1, 1)}}}}, "a"),
    ({"items.kind": {"$all": ["soft"]}}, "ab"),
    ({"items": {"$size": 0}}, "d"),
    ({"items.0.kind": "hard"}, "c"),
    ({"status": re.compile("^ACT", re.I)}, "ad"),
    ({"status": {"$regex": "^act", "$options": "x"}}, "ad"),
    ({"score": {"$mod": [4, 1]}}, "cd"),
    ({"score": {"$bitsAllSet": [0, 3]}}, "c"),
    ({"score": {"$type": "int"}, "d": {"$type": "null"}}, "d"),
    ({"$expr": {"$gt": ["$score", 6]}}, "ac"),
    ({"score": {"$not": {"$gt": 6}}}, "bd"),
    ({"$where": "this.score > 4 and doc['status'] == 'active'"}, "ad"),
    ({"$where": lambda d: d["score"] == 3}, "b"),
    ({"$jsonSchema": {"required": ["status"], "properties": {"score": {"minimum": 6}}}}, "ac"),
    ({"at": {"$geoWithin": {"$box": [[0, 0], [2, 4]]}}}, "ac"),
    ({"at": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}}}, "a"),
    ({"at": {"$near": [0, 0], "$maxDistance": 3}}, "ac"),
])
def test_matches(df, spec, expected):
    assert ids(df, spec) == expected


@pytest.mark.parametrize("spec", [{"$foo": 1}, {"a": {"$cmp": 1}}, {"score": {"$nope": 1}}])
def test_unknown(df, spec):
    with pytest.raises(UnsupportedOperator):
        compile_filter(spec, Scope.of(df.schema))


@pytest.mark.parametrize("spec", [{"$and": []}, {"score": {"$in": 5}}, {"score": {"$mod": [0, 1]}}, {"score": {"$size": -1}}, {"score": {"$options": "i"}}, {"$jsonSchema": {"nope": 1}}])
def test_bad(df, spec):
    with pytest.raises(QueryError):
        compile_filter(spec, Scope.of(df.schema))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS r", "concat('n', id) AS name").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = df.where(compile_filter({"id": {"$gte": 40}, "name": {"$regex": "^n5"}}, Scope.of(df.schema))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,40)" in plan and "StringStartsWith(name,n5)" in plan
