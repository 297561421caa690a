"""Elimination, wide components, repeated ids and clashing names of the top-k search, against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdoc.llm import topk


def brute(rows, k, step):
    whole = [(i, [int(np.floor(np.float64(64) * x)) for x in v]) for i, v in rows]
    out = {}
    for q, v in whole:
        if q % step == 0:
            scores = out.setdefault(q, [])
            scores += [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v)]
    return {q: [(r + 1, i, max(min(-s, topk.MOST), topk.LEAST)) for r, (s, i) in enumerate(sorted(x)[:k])] for q, x in out.items() if x}


def answers(df, k, step):
    got = defaultdict(list)
    for r in topk.top_k(df, k, F.col("vec_id") % step == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return dict(got)


def clustered(rng, n, d=12, centres=16):
    middle = rng.normal(size=(centres, d)) * 40
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * 0.5


@pytest.mark.parametrize("make", ["clustered", "spread"])
def test_blocks_and_cells(spark, monkeypatch, make):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 900) if make == "clustered" else rng.normal(size=(900, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(df, 7, 20) == brute(rows, 7, 20)


def test_elimination_evaluates_few_candidates():
    rng = np.random.default_rng(5)
    rows = np.floor(64 * clustered(rng, 4000))
    pivots = topk.pick_pivots(rows[:1000], topk.PIVOTS)
    table = topk.distances(rows, pivots).astype(np.float32)
    block = topk.Block(np.arange(4000), rows, table, (pivots**2).sum(1).max())
    queries = np.arange(0, 4000, 100)
    scores = rows[queries] @ rows.T
    index, names, found = block.search(rows[queries], queries, table[queries], np.full(len(queries), -np.inf), 10, probe=0)
    for n, q in enumerate(queries):
        best = sorted((-s, i) for i, s in enumerate(scores[n]) if i != q)[:10]
        assert sorted(zip(-found[index == n], names[index == n], strict=True)) == best
    assert block.evaluated < 0.2 * len(queries) * 4000
    # with the true k-th scores as floors still fewer are evaluated
    floors, before = np.array([found[index == n].min() for n in range(len(queries))]), block.evaluated
    index, names, _ = block.search(rows[queries], queries, table[queries], floors, 10)
    assert len(names) == 10 * len(queries) and block.evaluated - before <= before


def test_wide_components_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(2**19, 2**20, 64) * (64 if i % 3 == 0 else 1)]) for i in range(60)]  # up to 2^32 after scaling
    rows += [(100, [1e300] * 64), (120, [-1e300] * 64), (140, [2.0**55] * 64), (160, [0.5] * 64), (180, [-(2.0**56)] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [max(min(int(np.floor(64 * x)), topk.MOST), topk.LEAST) for x in v] for i, v in rows}
    got = answers(df, 9, 20)
    for q in [i for i in whole if i % 20 == 0]:
        clip = lambda s: max(min(s, topk.MOST), topk.LEAST)
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], w, strict=True))), i) for i, w in whole.items() if i != q)[:9]
        assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_repeats_ties_and_clashing_names(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [0.0, 9.0]), (40, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in ("id", "v", "q", "d", "cell", "block", "t", "floor", "score", "rank")])
    got = answers(df, 3, 20)
    assert [(r, s) for r, _, s in got[40]] == [(1, 64 * 64 * 18), (2, 64 * 64 * 8), (3, 64 * 64 * 8)] and [i for _, i, _ in got[40]] == [3, 1, 2]
    assert [i for _, i, _ in got[20]][0] == 3 and 20 not in [i for _, i, _ in got[20]]
    empty = spark.createDataFrame([(20, []), (21, []), (40, [])], "vec_id long, embedding array<double>")
    assert answers(empty, 2, 20) == {20: [(1, 21, 0), (2, 40, 0)], 40: [(1, 20, 0), (2, 21, 0)]}
    assert answers(df.where("false"), 3, 20) == {}
