"""Toxic words are learned from all labelled documents, however few of them the gradient uses."""

import numpy as np

from sparkdoc.llm import toxicity


def test_rare_words_are_learned_beyond_the_sample(spark):
    rng = np.random.default_rng(6)
    vocabulary, rare = [f"word{k}" for k in range(300)], [f"vile{k}" for k in range(25)]
    rows, labels = [], []
    for i in range(6000):
        sentences = [" ".join(rng.choice(vocabulary, 8)) for _ in range(int(rng.integers(1, 6)))]
        toxic = i % 8 == 0
        if toxic:
            sentences[0] += f" {rare[i // 8 % 25]}" if i % 16 else " commonslur"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    tests = [(10_000 + k, f"quite word1 word2 {w} word3.") for k, w in enumerate(rare)]
    plain = [(20_000 + k, " ".join(rng.choice(vocabulary, 8)) + ".") for k in range(200)]
    documents = spark.createDataFrame([*rows, *tests, *plain], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(documents, lab, most=60)
    scores = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    assert [w for (i, _), w in zip(tests, rare, strict=True) if scores[i] < 0.5] == []
    assert sum(scores[i] >= 0.5 for i, _ in plain) <= 2


def test_counts_are_those_of_the_whole(spark):
    texts = [(k, t, k % 2) for k, t in enumerate(["a b. a", "b c", "", None, "a", "c c c", "a b c", "d"] * 20)]
    documents = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string").repartition(5)
    lab = spark.createDataFrame([(k, y) for k, _, y in texts], "__id long, __y int")
    found = toxicity._count_all(documents, lab, "doc_id", "text")
    assert (found.toxic, found.clean) == (80, 80)
    for word in "abcd":
        (f,) = toxicity.bags(np.frombuffer(word.encode(), np.uint8), np.array([0, 1])).feature
        for got, y in ((found.hits, 1), (found.misses, 0)):
            assert got[f] == sum(word in (t or "") for _, t, z in texts if z == y)
