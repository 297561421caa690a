"""Repeated ids, clashing names and filters that are too small: suffix dedup by rows, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdoc.llm import suffix_dedup, util


def brute(documents, length=100):
    """{document: (bytes, removed, runs, sha of the rest)}; documents in order, ((id, tie), bytes) each."""
    seen, out = set(), {}
    for name, raw in sorted(documents):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(raw[p : p + length])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[name] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def rows_with_repeated_ids(seed):
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list("abcdé fgh"), 300)) for _ in range(4)]
    own = lambda n: "".join(rng.choice(list("xyz uv"), int(n)))
    rows = []
    for i in range(90):
        p = passages[int(rng.integers(4))]
        a, b = int(rng.integers(0, 120)), int(rng.integers(150, 300))
        rows.append((int(rng.integers(0, 40)), [p, own(150) + p[a:b], own(90) + p[a:b] + own(60), p[a:] + p[:b], "ab" * 90][int(rng.integers(5))]))
    return rows + rows[:12] + [(3, None), (3, ""), (None, passages[0])]


@pytest.mark.parametrize(("hot", "bits"), [(4000, 27), (2, 27), (4000, 3), (2, 3)])
def test_repeated_ids(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(util, "MOST_BITS", bits)  # at 3 bits no filter fits and joins do the work
    rows = rows_with_repeated_ids(hot + bits)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    tie = {(r.doc_id, r.text): r.tie for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    names = {(i, tie[i, t], (t or "").encode()) for i, t in rows if i is not None}
    expected = brute([((i, k), raw) for i, k, raw in names])
    whole = sorted(repr(expected[i, tie[i, t]]) if i is not None else repr((len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest())) for i, t in rows)
    got = suffix_dedup.remove_repeats(df.select("doc_id", "text")).collect()
    assert sorted(repr((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == whole
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None)
    cleaned = suffix_dedup.drop_repeats(df.withColumn("n_chars", F.char_length("text"))).collect()
    assert len(cleaned) == len(rows)
    for r in cleaned:
        i, t = rows_of(df)[r.row]
        if i is None or expected[i, tie[i, t]][1] == 0:
            assert r.text == t
        else:
            assert len(r.text.encode()) <= expected[i, tie[i, t]][0] - expected[i, tie[i, t]][1] and r.n_chars == len(r.text)


def rows_of(df, held={}):  # noqa: B006 - a cache
    if id(df) not in held:
        held[id(df)] = {r.row: (r.doc_id, r.text) for r in df.collect()}
    return held[id(df)]


def test_few_rows_with_one_id(spark):
    passage = "".join(chr(97 + k % 26) + str(k) for k in range(80))[:160]
    df = spark.createDataFrame([(1, "first " + passage), (2, "a" * 20 + passage), (2, passage + "b" * 20), (3, "plain")], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 160), (2, 160), (3, 0)]


def test_clashing_names_and_long_texts(spark):
    passage = " ".join(f"long passage number {k}" for k in range(40))
    rows = [(1, passage + " x" * 150_000, "c", "s", "i", "n"), (2, "other " + passage, "c", "s", "i", "n"), (3, passage + " x" * 150_000, "c", "s", "i", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy string, spans string, __id string, __NEW string")
    out = {r.doc_id: r for r in suffix_dedup.drop_repeats(df).collect()}
    assert all((r["copy"], r.spans, r["__id"], r["__NEW"]) == ("c", "s", "i", "n") for r in out.values())
    assert out[1].text.startswith(passage) and len(out[1].text) < len(passage) + 300 and out[2].text == "other " and out[3].text == ""
    assert suffix_dedup.drop_repeats(df.where("false")).count() == 0


def test_hot_strings_are_sent_once_a_batch(spark, monkeypatch):
    """What a bucket is told of a string does not grow with the documents that hold it."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    passage = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 300))
    told, written = [], suffix_dedup.cut

    def watched(df):
        made = written(df)
        if "times" in made.columns:
            told.append(made.where("bucket is not null").agg(F.sum(F.octet_length("names") / 16)).first()[0])
        return made

    monkeypatch.setattr(suffix_dedup, "cut", watched)
    for n in (40, 400):
        df = spark.createDataFrame([(i, f"{i} begins here " + passage) for i in range(n)], "doc_id long, text string").coalesce(1)
        assert sum(r.n_removed >= 300 for r in suffix_dedup.remove_repeats(df).collect()) == n - 1
    assert len(told) == 2 and 0 < told[1] < 2 * told[0]  # ten times the documents
