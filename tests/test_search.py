import pytest

from sparkdoc.errors import QueryError
from sparkdoc.operators import search


def meta(df, **spec):
    return [r.asDict(True) for r in search.search_meta(df, spec).collect()]


def test_counts_are_whole(spark):
    df = spark.range(2500).selectExpr("id AS _id", "'word' AS t", "if(id % 2 = 0, 'a', 'b') AS g")
    every = {"exists": {"path": "t"}}
    assert meta(df, **every, count={}) == [{"count": {"total": 2500, "exact": True}}]
    assert meta(df, **every, count={"type": "lowerBound"}) == [{"count": {"lowerBound": 2500, "exact": True}}]
    for threshold, n in ((1000, 1000), (2499, 2499), (2500, 2500), (9999, 2500)):
        capped = threshold < 2500
        assert meta(df, **every, count={"type": "lowerBound", "threshold": threshold}) == [{"count": {"lowerBound": n, "exact": not capped, "threshold": threshold, "cappedByThreshold": capped}}]
    facet = {"operator": every, "facets": {"g": {"type": "string", "path": "g"}}}
    buckets = {"g": {"buckets": [{"_id": "a", "count": 1250}, {"_id": "b", "count": 1250}]}}
    assert meta(df, facet=facet) == [{"facet": buckets}]
    assert meta(df, facet=facet, count={}) == [{"count": {"total": 2500, "exact": True}, "facet": buckets}]
    for bad in ({"type": "other"}, {"type": "total", "threshold": 5}, {"type": "lowerBound", "threshold": 0}):
        with pytest.raises(QueryError):
            search.search_meta(df, {**every, "count": bad})


def test_all_passages_are_shown(spark):
    df = spark.createDataFrame([(1, [f"license number {k}" for k in range(9)], "a license too")], "_id long, t array<string>, u string")
    query = {"text": {"query": "license", "path": ["t", "u"]}}
    shown = lambda **how: search.search(df, {**query, "highlight": {"path": ["t", "u"], **how}}).first()["__meta_searchHighlights"]
    assert [(h.path, h.text) for h in shown()] == [*[("t", f"license number {k}") for k in range(9)], ("u", "a license too")]
    assert len(shown(maxNumPassages=3)) == 3
    with pytest.raises(QueryError):
        shown(maxNumPassages=0)
