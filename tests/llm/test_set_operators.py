"""Joins, search, dedup, mixing, sharding and the pipeline against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdoc.llm import hypergeometric, mixing, ngram_join, sharding, suffix_dedup, topk
from sparkdoc.llm.util import Bits, label_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, families=6, size=14):
    """Families of texts with few, many and shared edits, copies, short texts and a line that most texts share."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts, i = {}, 0
    for _ in range(families):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 150))))
        for _ in range(size):
            words = base.copy()
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary[:5]))
            if rng.random() < 0.2:
                words = words[: len(words) - int(rng.integers(0, 12))]
            texts[i] = ("one very common line of many words " if rng.random() < 0.6 else "") + " ".join(words).upper()
            i += 1
    for t in (None, "", "one", "ONE", "one two three", "  \t ", "a b c d", "a b c d e"):
        texts[i] = t
        i += 1
    return texts


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed, k, percent):
    texts = near_copies(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df, ngram_join.Jaccard(k, percent)).collect()}
    assert got == components(texts, k, percent)
    assert len({c for _, c in got.values()}) < len(got) - 10


def test_ngram_join_edges(spark):
    how = ngram_join.Jaccard(4, 85)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join_components(empty, how).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b\tc d e"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.join_components(odd, how).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    kept = ngram_join.drop_near_copies(odd, how)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3]


def test_frequent_tokens_are_left_out_alike(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 2000)
    monkeypatch.setattr(ngram_join, "BUCKET", 300)
    texts = near_copies(7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    how = ngram_join.Jaccard(5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df, how).collect()} == components(texts, 5, 80)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(500, 540)]
    root = {x: x for p in links for x in p}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in label_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == root[x] for x in root)
    assert label_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_filter(spark):
    keys = spark.range(0, 5000, 5)
    bits = Bits(1000).fill(keys)
    assert bits.holds(np.arange(0, 5000, 5)).all()
    assert bits.holds(np.setdiff1d(np.arange(5000), np.arange(0, 5000, 5))).mean() < 0.05


def brute_removal(docs, length=100):
    seen, out = set(), {}
    for i in sorted(docs):
        raw = docs[i]
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(raw[p : p + length])
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeating(seed):
    rng = np.random.default_rng(seed)
    passages = ["".join(rng.choice(list("abcdé fgh"), 400)) for _ in range(5)]
    own = lambda n: "".join(rng.choice(list("xyz uv"), int(n)))
    docs = {}
    for i in range(110):
        kind, p = rng.random(), passages[int(rng.integers(5))]
        a, b = int(rng.integers(0, 200)), int(rng.integers(200, 400))
        docs[i] = p if kind < 0.2 else own(rng.integers(200)) + p[a:b] + own(rng.integers(200)) if kind < 0.65 else "ab" * int(rng.integers(10, 300)) if kind < 0.75 else "é" * int(rng.integers(20, 200)) if kind < 0.8 else own(rng.integers(300))
    return docs | {200: None, 201: "", 202: "short"}


@pytest.mark.parametrize("hot", [4000, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = repeating(hot)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, n_chars int")
    expected = brute_removal({i: (t or "").encode() for i, t in docs.items()})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == expected and sum(x[1] for x in got.values()) > 1000
    cleaned = {r.doc_id: r for r in suffix_dedup.drop_repeats(df).collect()}
    assert set(cleaned) == set(docs)
    for i, t in docs.items():
        if expected[i][1] == 0:
            assert cleaned[i].text == t
        else:
            assert len(cleaned[i].text.encode()) <= expected[i][0] - expected[i][1] and cleaned[i].n_chars == len(cleaned[i].text)


def test_suffix_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    long = "q" * 150
    odd = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()) == [(0, 0), (1, 149), (1, 149), (2, 150)]


@pytest.mark.parametrize("alphabet", [b"ab", b"abc", b"ab\xff", bytes(range(256))])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(len(alphabet))
    for n in (1, 2, 7, 60, 400):
        raw = bytes(rng.choice(list(alphabet), n).astype(np.uint8))
        text = np.frombuffer(raw, np.uint8)
        order = suffix_dedup.suffix_array(text, 100)
        heads = [raw[i : i + 100] for i in order]
        assert heads == sorted(heads) and sorted(order.tolist()) == list(range(n))
        shared = suffix_dedup.common_prefixes(suffix_dedup.eight_bytes(text), order, 100)
        for a, b, got in zip(order, order[1:], shared[1:], strict=False):
            x, y = raw[a:], raw[b:]
            same = next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
            assert got == min(same, 100) or same == min(len(x), len(y))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    vectors += [(1000 + i, vectors[20][1]) for i in range(60)]  # ties
    odd = [(500, None), (501, [float("nan")] * 8), (502, [None] + [0.0] * 7), (None, [0.0] * 8), (520, [float("inf")] + [0.0] * 7), (540, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "e") for i, v in vectors + odd], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in topk.top_k(df, 20, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    for q in [i for i in whole if i % 20 == 0]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in whole if i % 20 == 0}  # the short vector has nobody to meet
    assert topk.top_k(df.where("false"), 3).count() == 0
    assert topk.top_k(df.where("vec_id in (1, 2)"), 5).count() == 2


def test_hypergeometric_draws():
    rng = np.random.default_rng(0)
    draws = [hypergeometric.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15
    big = [hypergeometric.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**4) for _ in range(300)]
    assert abs(np.mean(big) - 3000) < 15 and 30 < np.std(big) < 65
    matrix = hypergeometric.communication_matrix(rng, [5, 0, 9, 3], [6, 6, 5])
    assert [sum(r) for r in matrix] == [5, 0, 9, 3] and [sum(c) for c in zip(*matrix, strict=True)] == [6, 6, 5]


def test_sharding(spark):
    df = spark.range(5003).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), (F.col("id") % 7).alias("v"))
    rows = sharding.shard_rows(df, 24, ["doc_id"]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == list(range(5003)) and all(r.v == r.doc_id % 7 for r in rows)
    assert sorted(by) == list(range(24)) and {len(x) for x in by.values()} == {208, 209}
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard_rows(df.repartition(5), 24, ["doc_id"]).collect()))
    first = [r.doc_id for r in rows if r.slot == 0]
    assert 1500 < np.mean(first) < 3500
    assert sharding.shard_rows(df.where("false"), 24, ["doc_id"]).count() == 0
    few = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    assert sorted((r.shard, r.slot) for r in sharding.shard_rows(few, 2, ["doc_id"]).collect()) == [(0, 0), (0, 1), (1, 0)]


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([10, 1000], [5, 2], 1515, 2) == [20, 1495]
    assert mixing.targets([0, 10], [1, 1], 15, 2) == [0, 15]
    assert mixing.targets([], [], 0, 2) == []


def test_mixing(spark):
    rng = np.random.default_rng(8)
    names = ["hot"] * 6 + ["b", "c", None]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), names[int(rng.integers(len(names)))]) for i in range(6000)] + [(7000, None, "b"), (7001, "\u00a0 \u00a0", "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_words(df).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size and len(r.shards) <= 2 and all(0 <= s < 8 for s in r.shards)
    order = ["b", "c", "hot", "only", None]
    weights = [5, 2, 1, 5, 2]
    expected = mixing.targets([sizes[s] for s in order], weights, 1.5 * sum(sizes.values()), 2)
    assert [target[s] for s in order] == pytest.approx(expected)
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed_words(df.repartition(7)).collect()))
    drawn = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert all(drawn[r.doc_id] == len(r.shards) for r in got)
    loads = Counter(s for r in got for s in r.shards)
    assert max(loads.values()) < 1.6 * min(loads.values())
    assert mixing.mixed_words(df.where("false")).count() == 0


def test_quotas_are_exact():
    rng = np.random.default_rng(1)
    dealt = mixing.split_quotas(rng, [10, 0, 33, 7], 6)
    assert [sum(x) for x in zip(*dealt, strict=True)] == [10, 0, 33, 7] and {sum(d) for d in dealt} <= {8, 9}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    from sparkdoc.llm import bpe

    rng = np.random.default_rng(9)
    vocabulary = [f"word{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = text(70)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 6 == 0
        rows.append((i, text(int(rng.integers(20, 90))) + (". you slurword" if toxic else ""), "en", f"s{i % 4}", 0))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, rows[1][1], "en", "s0", 0), (1001, rows[2][1] + " more", "en", "s1", 0), (1002, text(30) + " " + passage, "en", "s1", 0), (1003, text(30) + " " + passage, "en", "s2", 0), (1004, None, "en", None, 0), (1005, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    after_toxic = {r.doc_id for r in kept["toxicity"]}
    assert not any("slurword" in (t or "") for i, t, *_ in rows if i in after_toxic) and len(after_toxic) == len(rows) - 67
    groups = components({i: t for i, t, *_ in rows if i in after_toxic}, 5, 80)
    assert {r.doc_id for r in kept["ngram_join"]} == {i for i, (_, c) in groups.items() if c == i}
    cleaned = {r.doc_id: r.text for r in kept["suffix_dedup"]}
    assert passage in cleaned[1002] and passage not in cleaned[1003] and set(cleaned) == {r.doc_id for r in kept["ngram_join"]}
    expected = brute_removal({r.doc_id: (r.text or "").encode() for r in kept["ngram_join"]})
    assert all(len((cleaned[i] or "").encode()) == e[0] - e[1] for i, e in expected.items())
    times = Counter(r.doc_id for r in kept["mixing"])
    assert max(times.values()) == 2 and set(times) <= set(cleaned)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert Counter(r.doc_id for r in kept["bpe"]) == times
    assert all(list(r.ids) == reference.encode_ordinary(cleaned[r.doc_id] or "") for r in kept["bpe"])
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r.ids_sha256 for r in kept["bpe"])


@pytest.mark.parametrize("bits", [27, 3])
def test_one_family_of_near_copies(spark, monkeypatch, bits):
    """A third of all rows alike but unequal: blocks of few members and filters too small for anything."""
    from sparkdoc.llm import util

    monkeypatch.setattr(ngram_join, "TOGETHER", 4)
    monkeypatch.setattr(util, "MOST_BITS", bits)
    rng = np.random.default_rng(12)
    vocabulary = [f"v{k}" for k in range(4000)]
    base = list(rng.choice(vocabulary, 120))
    texts = {}
    for i in range(150):
        words = base.copy() if i % 3 == 0 else list(rng.choice(vocabulary, 60))
        for _ in range(int(rng.integers(1, 6))):
            words[int(rng.integers(len(words)))] = f"own{i}" if rng.random() < 0.5 else "shared"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    how = ngram_join.Jaccard(4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df, how).collect()}
    assert got == components(texts, 4, 85)


def test_words_that_fool_polynomial_hashes(spark):
    """Thue-Morse words of 4096 letters have equal polynomials modulo 2^64; digests tell them apart."""
    x, y = "a", "b"
    for _ in range(12):
        x, y = x + y, y + x
    df = spark.createDataFrame([(1, f"one two three {x} four"), (2, f"one two three {y} four"), (3, f"one two three {x} four")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(df, ngram_join.Jaccard(4, 85)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
