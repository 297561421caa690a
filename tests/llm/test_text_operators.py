"""Fingerprints, BPE, URLs, licenses, toxicity: small tables with every awkward case."""

import hashlib
import unicodedata

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkdoc.llm import bpe, fingerprint, licenses, toxicity, urls

public_tokenizers = pytest.importorskip("public_tokenizers")

ROWS = [(1, "Hello  World"), (2, None), (3, ""), (4, "ﬁx É\u0301 ẞ 日本語" * 3), (5, "hello world "), (5, "hello world "), (6, "a" * 30_000), (None, "no id"), (7, "x\u0000y\r\n  z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i, "u") for i, t in ROWS], "doc_id long, text string, n_tokens long, fingerprint string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken(docs, empty, ranks, reference):
    got = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]
    expected = [(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    for r in got.collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    back = bpe.decode_ids(got, ranks, out="again")
    assert back.where("again <> decoded").count() == 0
    assert bpe.encode_documents(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_replay_on_random_texts(ranks, reference):
    rng = np.random.default_rng(5)
    alphabets = ["ab", "abcdeftionhs ", "aA1 .\n'", "éü日本\U0001f600 x"]
    texts = ["".join(rng.choice(list(a), int(n))) for a in alphabets for n in rng.integers(0, 200, 150)]

    class Shared:
        value = ranks

    encode, _ = bpe.encoder(Shared, public_tokenizers.PATTERN)
    assert [list(x) for x in encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_replay_postpones_when_a_merge_makes_a_lower_pair():
    # after "b"+"c" the pair "a"+"bc" ranks lower than the merge that made it
    letters = {bytes([b]): 1000 + b for b in range(256)}
    ranks = letters | {b"bc": 700, b"abc": 300, b"bcb": 800}

    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks.get(x + y, 10**9), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
            if not pairs or min(pairs)[0] == 10**9:
                return [ranks[p] for p in parts]
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    words = [bytes(np.random.default_rng(s).choice(list(b"abc"), 12)) for s in range(300)]
    ids, starts = bpe.Replay(ranks).encode(words)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [alone(w) for w in words]


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split())


def test_fingerprints(spark, docs, empty):
    rows = {r.doc_id: r for r in fingerprint.likeness(docs).collect()}
    assert len(rows) == len({i for i, _ in ROWS})
    ids = sorted({i for i, _ in ROWS if i is not None}, reverse=True) + [None]
    texts = dict(ROWS)
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        if i != 5:  # the repeated row follows itself
            assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert rows[i].near_next == float(canonical(text) == canonical(after))
        assert rows[i].n_chars == len(text)
    assert rows[1].fingerprint == rows[5].fingerprint != rows[7].fingerprint
    classes = {r.class_id: r.copies for r in fingerprint.exact_classes(docs).collect()}
    assert classes[1] == 3 and classes[2] == 2
    assert fingerprint.exact_classes(empty).count() == 0
    one = fingerprint.likeness(spark.createDataFrame([(9, "only one")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 8)]


def test_order_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_BUCKET", 7)
    n = 120
    rows = [(i * i % 1009, f"text {i} " * (i % 5)) for i in range(n)]
    texts = dict(rows)
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_urls(spark):
    rules = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/")]
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "https://EXAMPLE.com/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.net/x.example.com/en/": ("a.net", "/x.example.com/en/", None, "allow"),
        "ftp://b.net/es/y": ("b.net", "/es/y", "net/es/", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://c.net\n/es/z://d.com/": ("c.net\n", "/es/z://d.com/", None, "allow"),
        "http://" + "h" * 5000 + ".com/": ("h" * 5000 + ".com", "/", "com/", "allow"),
    }
    df = spark.createDataFrame([(u, "old") for u in cases] + [(None, "old")], "url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()}
    assert got == cases | {None: ("", "", None, "allow")}
    assert urls.judge_urls(df.where("false"), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, [], default="block").collect()} == {"block"}


def test_automaton_against_regular_expressions():
    import re

    rng = np.random.default_rng(2)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**"], int(n))) for n in rng.integers(1, 9, 60)]
    machine = urls.Automaton(globs)
    assert machine.words > 1
    texts = ["".join(rng.choice(["a", "b", "/"], int(n))) for n in rng.integers(0, 9, 400)]
    expressions = [re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", g)), re.S) for g in globs]
    expected = [next((k for k, x in enumerate(expressions) if x.fullmatch(t)), -1) for t in texts]
    assert machine.first([t.encode() for t in texts]).tolist() == expected


def test_licenses(spark):
    line = "Licensed under the Apache License, Version 2.0."
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("Software", "program").replace("sublicense, ", "")
    texts = {1: f"words before\n{line}\nwords after", 2: f"{line} {line}", 3: None, 4: "", 5: "nothing here", 6: "x " * 3000 + changed + " y" * 3000, 7: "Apache Version"}
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1].license, got[1].coverage, got[1].first_word, got[1].end_word) == ("apache-2.0-line", 1.0, 2, 10)
    assert got[2].n_licenses == 2 and got[6].license == "mit" and 0.8 <= got[6].coverage < 1
    assert [got[k].license for k in (3, 4, 5, 7)] == [None] * 4


def test_patience_is_an_alignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 12, 25).tolist(), rng.integers(0, 12, 20).tolist()
        found = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:], strict=False))
    words = [f"w{k}" for k in range(30)]
    assert licenses.patience(words, words[3:20]) == [(k + 3, k) for k in range(17)]
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_toxicity_finds_sentences(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(900):
        sentences = [" ".join(rng.choice(vocabulary, 8)) for _ in range(int(rng.integers(1, 12)))]
        toxic = i % 5 == 0
        if toxic:
            sentences[int(rng.integers(len(sentences)))] += " you " + str(rng.choice(["vileword", "slurword"]))
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "you vileword"), (None, "you slurword here")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(documents, spark.createDataFrame([*labels, (None, 1), (3, None), (3, 0)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    held = {r.i for r in spark.range(900).select(F.col("id").alias("i")).where(toxicity.held_out(F.col("i"))).collect()}
    right = [(got[i].score >= 0.5) == bool(y) for i, y in labels if i in held]
    assert sum(right) / len(right) > 0.97
    assert got[2000].score == got[2001].score == 0.0 and got[2002].score > 0.5 and got[None].score > 0.5
    text = dict(rows)[0].encode()
    spans = [text[s.start : s.end] for s in got[0].offending]
    assert len(spans) == 1 and (b"vileword" in spans[0] or b"slurword" in spans[0])
    clean = toxicity.reject(documents, model)
    assert clean.columns == documents.columns and {2000, 2001} <= {r.doc_id for r in clean.collect()} and 2002 not in {r.doc_id for r in clean.collect()}
    none = toxicity.fit(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.score(documents, none).collect()) < 0.5
