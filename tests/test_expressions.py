import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkdoc.errors import QueryError, UnsupportedOperator
from sparkdoc.functions import Scope, compile_expression, operators, register
from sparkdoc.functions.core import E, value

T = datetime.datetime(2024, 2, 29, 13, 5, 6, 789000)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 2.5, "Añb x", [1, 2, None], (1,), T), (2, None, "", [], None, None)], "i int, d double, s string, a array<int>, m struct<a:int>, t timestamp_ntz")


def out(df, spec):
    e = compile_expression(spec, Scope.of(df.schema))
    made = df.select(e.col.alias("x"))
    assert made.schema["x"].dataType.simpleString() == e.type.simpleString()
    return [r.x for r in made.collect()]


@pytest.mark.parametrize(("spec", "expected"), [
    ({"$add": ["$i", "$d"]}, [3.5, None]),
    ({"$divide": [7, 2]}, [3.5, 3.5]),
    ({"$mod": [-7, 3]}, [-1, -1]),
    ({"$round": ["$d", 0]}, [2, None]),
    ({"$trunc": [-2.7, 0]}, [-2, -2]),
    ({"$range": [5, 1]}, [[], []]),
    ({"$range": [5, 1, -2]}, [[5, 3], [5, 3]]),
    ({"$sum": "$a"}, [3, 0]),
    ({"$avg": "$a"}, [1.5, None]),
    ({"$percentile": {"input": [1, 2, 3, 4], "p": [0.25, 0.5], "method": "approximate"}}, [[1, 2], [1, 2]]),
    ({"$gt": ["$d", None]}, [True, False]),
    ({"$lt": [None, 1]}, [True, True]),
    ({"$gt": ["x", 5]}, [True, True]),
    ({"$gt": [{"$toDouble": "nan"}, -1e300]}, [False, False]),
    ({"$eq": ["$nothing", None]}, [True, True]),
    ({"$cmp": ["$i", 1]}, [0, 1]),
    ({"$and": ["$s", 1]}, [True, True]),
    ({"$cond": [0, 1, 2]}, [2, 2]),
    ({"$indexOfBytes": ["$s", "b"]}, [3, -1]),
    ({"$indexOfCP": ["$s", "b"]}, [2, -1]),
    ({"$substrBytes": ["$s", 0, 1]}, ["A", ""]),
    ({"$toUpper": None}, ["", ""]),
    ({"$split": ["a.b.c", "."]}, [["a", "b", "c"]] * 2),
    ({"$trim": {"input": " \t x\n"}}, ["x", "x"]),
    ({"$replaceOne": {"input": "aaa", "find": "a", "replacement": "b"}}, ["baa", "baa"]),
    ({"$arrayElemAt": ["$a", 5]}, [None, None]),
    ({"$slice": [[1, 2, 3, 4], -3, 2]}, [[2, 3]] * 2),
    ({"$reduce": {"input": [1, 2], "initialValue": 0, "in": {"$add": ["$$value", "$$this", 0.5]}}}, [4.0, 4.0]),
    ({"$zip": {"inputs": [[1, 2], [3]], "useLongestLength": True, "defaults": [0, 9]}}, [[[1, 3], [2, 9]]] * 2),
    ({"$setUnion": ["$a", [2, 7]]}, [[1, 2, None, 7], [2, 7]]),
    ({"$week": "$t"}, [8, None]),
    ({"$dateDiff": {"startDate": datetime.datetime(2024, 1, 1, 23), "endDate": datetime.datetime(2024, 1, 2, 1), "unit": "day"}}, [1, 1]),
    ({"$dateTrunc": {"date": "$t", "unit": "week"}}, [datetime.datetime(2024, 2, 25), None]),
    ({"$dateAdd": {"startDate": "$t", "unit": "year", "amount": 1}}, [datetime.datetime(2025, 2, 28, 13, 5, 6, 789000), None]),
    ({"$toString": 1e16}, ["1e+16"] * 2),
    ({"$toString": 12345678.5}, ["12345678.5"] * 2),
    ({"$toString": 0.00012}, ["0.00012"] * 2),
    ({"$toString": 1.5e-07}, ["1.5e-07"] * 2),
    ({"$toBool": "false"}, [True, True]),
    ({"$toLong": "$t"}, [1709211906789, None]),
    ({"$toInt": 2.9}, [2, 2]),
    ({"$type": "$d"}, ["double", "null"]),
    ({"$bsonSize": "$m"}, [12, None]),
    ({"$let": {"vars": {"x": "$i"}, "in": {"$let": {"vars": {"x": 10, "y": "$$x"}, "in": {"$add": ["$$x", "$$y"]}}}}}, [11, 12]),
])
def test_values(df, spec, expected):
    assert out(df, spec) == expected


@pytest.mark.parametrize("spec", [{"$nope": 1}, {"$sin": 1}, {"$not": [1]}])
def test_unknown_operators(df, spec):
    with pytest.raises(UnsupportedOperator):
        compile_expression(spec, Scope.of(df.schema))


@pytest.mark.parametrize("spec", [{"$add": ["x", 1]}, {"$bitAnd": [True, 1]}, {"$round": [1, 200]}, {"$cond": [1, 2]}, "$$nobody", {"$median": {"input": 1, "method": "exact"}}])
def test_bad_specifications(df, spec):
    with pytest.raises(QueryError):
        compile_expression(spec, Scope.of(df.schema))


@pytest.mark.parametrize("spec", [{"$divide": [1, 0]}, {"$sqrt": -1}, {"$ln": 0}, {"$toInt": "x"}, {"$switch": {"branches": [{"case": False, "then": 1}]}}, {"$strLenCP": "$nothing"}])
def test_errors_in_the_data(df, spec):
    with pytest.raises(PySparkException):
        out(df, spec)


def test_own_operator(df):
    @register("$twice")
    def twice(spec, scope):
        e = value(spec, scope)
        return E(e.col * F.lit(2), e.type)

    assert out(df, {"$twice": "$i"}) == [2, 4]
    del operators["$twice"]
