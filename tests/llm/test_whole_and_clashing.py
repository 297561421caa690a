"""Whole licence texts, shards and mixes under awkward names and repeats, uniformity, and many buckets of fingerprints."""

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdoc.llm import fingerprint, hypergeometric, license_texts, licenses, mixing, sharding, util


def test_every_template_finds_itself():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = scanner.scan(f"Copyright 2020 somebody. {text} And more words behind it.")
        assert [(x[0], x[1]) for x in found] == [(name, 1.0)], (name, found)


def test_broken_off_texts_are_not_whole():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = license_texts.TEXTS["mit"]
    assert scanner.scan(mit[: mit.index("INCLUDING BUT")]) == []
    longer = scanner.scan(mit[: mit.index("WHETHER IN AN")])
    assert longer[0][0] == "mit" and 0.8 <= longer[0][1] < 0.95


def test_spdx_lines_are_whole():
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    assert [x[0] for x in scan("# SPDX-License-Identifier: LGPL-2.1-or-later\n# SPDX-License-Identifier: MIT")] == ["spdx-lgpl-2.1", "spdx-mit"]
    assert scan("SPDX-License-Identifier: Frameworx-1.0") == [] and scan("SPDX-License-Identifier: XYZ-2.0") == [] and scan("") == []


def test_long_template_with_changes_and_twice():
    scanner = licenses.Scanner({"apache-2.0": license_texts.TEXTS["apache-2.0"]})
    text = license_texts.TEXTS["apache-2.0"].split()
    rng = np.random.default_rng(2)
    changed = " ".join("word" if rng.random() < 0.08 else w for w in text)
    found = scanner.scan("noise " * 333 + changed + " noise" * 500 + " " + changed)
    assert len(found) == 2 and all(0.85 < x[1] < 1 for x in found)


def test_patience_against_a_reference_alignment():
    """On texts whose common words are unique, patience matches as many words as the best alignment there is."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        template = [f"t{k}" for k in range(40)]
        text = [w if rng.random() < 0.8 else f"x{rng.integers(9)}" for w in template]
        at = int(rng.integers(0, 30))
        text[at:at] = [f"y{k}" for k in range(int(rng.integers(0, 6)))]
        best = sum(b.size for b in SequenceMatcher(None, text, template, autojunk=False).get_matching_blocks())
        assert len(licenses.patience(text, template)) == best == len(set(text) & set(template))


def test_licenses_of_awkward_tables(spark):
    rows = [(1, None), (None, "Released under the MIT License."), (2, ""), (3, "w " * 200_000 + "Released under the MIT License."), (4, "Released under the MIT License."), (4, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("license", "coverage", "matches", "n_licenses")})
    got = licenses.scan_licenses(df)
    assert sorted((r.doc_id or 0, r.license or "") for r in got.collect()) == [(0, "mit-line"), (1, ""), (2, ""), (3, "mit-line"), (4, "mit-line"), (4, "mit-line")]
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_shards_of_awkward_tables(spark):
    names = ["__part", "__rank", "__zone", "__at", "__shard", "__once", "part", "number", "to", "c0", "SLOT"]
    df = spark.range(300).select((F.col("id") % 3).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), *[F.lit(n).alias(n) for n in names], F.repeat(F.lit("x"), 50_000).alias("long"))
    rows = sharding.shard_rows(df, 7, ["doc_id"]).select("doc_id", "v", *names[:-1], "shard", "slot").collect()
    by = Counter(r.shard for r in rows)
    assert sorted(by.values()) == [42, 43, 43, 43, 43, 43, 43] and len(rows) == 300
    assert all(r[n] == n for r in rows for n in names[:-1])
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by.items())
    # rows alike in all columns: a rerun over other partitions deals alike
    alike = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("k"))
    first, second = (sorted(map(repr, sharding.shard_rows(alike.repartition(n), 5, ["k"]).collect())) for n in (3, 8))
    assert first == second and len(first) == 400


def test_uniformity_of_shards(spark):
    """Chi-square of shard by row over many seeds: every row is as likely to be in every shard and slot."""
    seen, slots, seeds = Counter(), Counter(), 24
    df = spark.range(40).coalesce(1)
    for seed in range(seeds):
        for r in sharding.shard_rows(df, 4, ["id"], seed=10 * seed).collect():
            seen[r.id % 8, r.shard] += 1
            slots[r.id % 8, r.slot] += 1
    for counts, cells in ((seen, 8 * 4), (slots, 8 * 10)):
        expected = 40 * seeds / cells
        chi = sum((n - expected) ** 2 / expected for n in counts.values()) + expected * (cells - len(counts))
        assert chi < cells + 5 * (2 * cells) ** 0.5


def test_uniformity_of_block_quotas():
    """The splitting tree deals as the multivariate hypergeometric law says: chi-square against its mean and variance."""
    rng, quotas, shards, times = np.random.default_rng(0), [12, 30, 6], 4, 3000
    dealt = np.array([mixing.split_quotas(rng, quotas, shards) for _ in range(times)])
    total = sum(quotas)
    for s in range(shards):
        for j, q in enumerate(quotas):
            mean, n = 12 * q / total, 12
            spread = n * (q / total) * (1 - q / total) * (total - n) / (total - 1)
            assert abs(dealt[:, s, j].mean() - mean) < 5 * (spread / times) ** 0.5
            assert abs(dealt[:, s, j].var() / spread - 1) < 0.2
    small = Counter(hypergeometric.hypergeometric(np.random.default_rng(1000 + k), 3, 3, 2) for k in range(3000))
    assert all(abs(small[k] / 3000 - p) < 0.04 for k, p in ((0, 0.2), (1, 0.6), (2, 0.2)))


def test_mixes_of_awkward_tables(spark):
    rows = [(None, "a b c", "s"), (1, "a b", "s"), (1, "a b", "s"), (1, "a b c d", "t"), (2, None, None), (3, "", "t"), (4, "w " * 100_000, "s")] + [(10 + i, "x y z", "t") for i in range(300)]
    names = ["__source", "__draws", "__draw", "__mine", "c0", "id", "__SIZE"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    words = mixing.mixed_words(df).collect()
    assert len(words) == len(rows) and all(r.taken <= 2 * r.size for r in words)
    assert sorted(map(repr, words)) == sorted(map(repr, mixing.mixed_words(df.repartition(5)).collect()))
    drawn = mixing.mixed_documents(df)
    assert drawn.columns == [*df.columns, "__shard", "__order"]
    assert all(r[n] == n for r in drawn.collect() for n in names)
    assert Counter(repr(r.doc_id) for r in drawn.collect()) == sum((Counter({repr(r.doc_id): len(r.shards)}) for r in words), Counter())
    assert mixing.mixed_documents(df.where("false")).count() == 0


def test_targets_against_a_brute_force():
    """Proportional shares with caps, by raising one common level until the total is reached."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        sizes, weights = rng.integers(0, 50, n).tolist(), rng.integers(1, 6, n).tolist()
        total = 1.5 * sum(sizes)
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(w * mid, 2 * s) for w, s in zip(weights, sizes, strict=True)) < total else (lo, mid)
        assert mixing.targets(sizes, weights, total, 2) == pytest.approx([min(w * hi, 2 * s) for w, s in zip(weights, sizes, strict=True)], abs=1e-6)


def test_more_than_two_hundred_buckets(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(fingerprint, "ROWS_PER_BUCKET", 2)
    rows = [(int(i), f"text {i} " + "y" * (i % 9)) for i in np.random.default_rng(6).permutation(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(fingerprint.id_buckets(df.withColumn("key", F.col("doc_id")), "key", 1200)[0]) > 200
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.likeness(df).collect()}
    texts = dict(rows)
    for i, t in texts.items():
        after, half = texts[(i - 1) % 1200], len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        util.shared_dir(Session())
    assert util.fresh(["__A", "b"], "a", "b", "b") == ["__a_", "__b", "__b_"]
