"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its hashed words; the document's
is their noisy-or, 1 - prod(1 - p). Only document labels are known: the gradient reaches the sentences through the
noisy-or, so the model learns which sentences make a document toxic and can point at them afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnp import hash_runs, lower_ascii, words
from .util import arrow_map, chunks, flat, gather

#: Hashed features; labelled documents of either label that the gradient may use at most; labelled documents that a word
#: needs; passes of the gradient.
FEATURES, MOST_TRAINING, LEAST_DOCUMENTS, ROUNDS = 1 << 18, 2500, 3, 120

#: Standard errors by which a word's log odds must favour toxic documents for it to be learned.
EVIDENCE = 4.0

#: What separates words: ASCII white space and punctuation. Sentences end at . ! ? and line feed.
_SPLIT = np.zeros(256, bool)
_SPLIT[: 0x30] = True
_SPLIT[0x3A:0x41] = True
_SPLIT[0x5B:0x61] = True
_SPLIT[0x7B:0x80] = True
_STOP = np.zeros(256, np.uint8)
_STOP[[ord(c) for c in ".!?\n"]] = 1


@dataclass
class Bags:
    """Words of many documents: feature, sentence (ascending, over all documents) and document of each word."""

    feature: np.ndarray
    sentence: np.ndarray
    document: np.ndarray  # of each sentence
    start: np.ndarray  # first byte of each sentence's words, within its document
    end: np.ndarray


def bags(raw: np.ndarray, offsets: np.ndarray) -> Bags:
    low = lower_ascii(raw)
    start, end, text = words(low, offsets, _SPLIT)
    feature = (hash_runs(low, start, end) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)
    stops = np.cumsum(_STOP[raw], dtype=np.int64)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Bags(feature, z, z, z, z)
    new = np.concatenate(([True], (stops[start[1:]] != stops[start[:-1]]) | (text[1:] != text[:-1])))
    sentence = np.cumsum(new) - 1
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    document = text[new]
    return Bags(feature, sentence, document, start[new] - offsets[document], end[last] - offsets[document])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """log(1 + exp(z)) of each sentence: minus the log of its chance to be harmless."""
        z = np.bincount(b.sentence, self.weights[b.feature], len(b.document)) + self.bias
        return np.logaddexp(0, z)

    def documents(self, b: Bags, n: int) -> np.ndarray:
        return -np.expm1(-np.bincount(b.document, self.sentences(b), n))


@dataclass
class Counts:
    """Labelled documents that hold each feature, toxic (hits) and clean (misses), and how many there are of both."""

    hits: np.ndarray
    misses: np.ndarray
    toxic: int
    clean: int


def count_words(feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, toxic: np.ndarray) -> Counts:
    pair = np.unique(document[sentence].astype(np.int64) * FEATURES + feature)
    bad = toxic[pair // FEATURES]
    hits, misses = (np.bincount(pair[x] % FEATURES, minlength=FEATURES) for x in (bad, ~bad))
    return Counts(hits, misses, int(toxic.sum()), int((~toxic).sum()))


def train(feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, share: float | None = None, rounds: int = ROUNDS, counts: Counts | None = None) -> Model:
    """Full-batch training of the noisy-or likelihood: Adam with decoupled soft thresholding.

    `share` is that of toxic documents outside the sample (default: in it); documents weigh accordingly, rare classes
    somewhat more. `counts` are those of all labelled documents (default: the sample's) and decide which words are
    learned; words seen in fewer than LEAST_DOCUMENTS of them stay at zero. A learned word that the sample lacks gets the
    weight with which a sentence of it alone is as toxic as the documents that hold it. Without labels of both kinds the
    model scores near the one it saw (near 0 for none).
    """
    n, toxic = len(label), label.astype(bool)
    if not n or toxic.all() or not toxic.any():
        return Model(np.zeros(FEATURES, np.float32), 0.0 if n and toxic.all() else -20.0)
    # documents that hold a word decide whether it is learned
    counts = counts or count_words(feature, sentence, document, toxic)
    doc_count = counts.hits + counts.misses
    known = np.flatnonzero(doc_count >= LEAST_DOCUMENTS)
    hits, misses, prior = counts.hits[known], counts.misses[known], counts.toxic / (counts.toxic + counts.clean)
    # only words that clearly favour toxic documents are learned: everything else would fit the sample's noise
    own = np.log((hits + 4 * prior) / (misses + 4 * (1 - prior)))
    odds = own - np.log(prior / (1 - prior))
    error = np.sqrt(1 / (hits + 4 * prior) + 1 / (misses + 4 * (1 - prior)))
    clear = odds > EVIDENCE * error
    known, own, w = known[clear], own[clear], odds[clear]
    prior = toxic.mean()
    column = np.full(FEATURES, -1, np.int64)
    column[known] = np.arange(len(known))
    use = column[feature] >= 0
    feat, sent = column[feature[use]], sentence[use]
    bias = float(np.log(max(prior, 1e-3) / max(1.0, len(document) / n))) - 2.0
    m = np.zeros(len(w) + 1)
    v = np.zeros(len(w) + 1)
    share = prior if share is None else share
    balanced, actual = (np.where(toxic, x / prior, (1 - x) / (1 - prior)) / n for x in (0.5, share))
    weigh = 0.25 * balanced + 0.75 * actual
    for t in range(1, rounds + 1):
        z = np.bincount(sent, w[feat], len(document)) + bias
        total = np.bincount(document, np.logaddexp(0, z), n)
        by_total = np.where(toxic, -1 / np.expm1(np.minimum(np.maximum(total, 1e-9), 700)), 1.0) * weigh
        by_z = by_total[document] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.append(np.bincount(feat, by_z[sent], len(w)), by_z.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w = w - step[:-1]
        w = np.maximum(w - 0.02, 0)
        bias -= step[-1]
    w = np.where(np.bincount(feat, minlength=len(w)) > 0, w, np.maximum(own - bias, 0))
    weights = np.zeros(FEATURES, np.float32)
    weights[known] = w
    return Model(weights, float(bias))


def held_out(id_column: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)) == 0


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_TRAINING) -> Model:
    """A model from the labelled documents outside the held-out fold. Words are counted over all of them; the gradient uses
    at most `most` of either label (by a hash of the id).

    If a label has more than that, one join of ids brings the labels to the documents; the counts of FEATURES words are a
    distributed sum of bounded size.
    Rows with a null id or label teach nothing; a document labelled twice counts as toxic if either label says so.
    """
    spark = documents.sparkSession
    lab = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_column))).groupBy(F.col(id_column).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    by_label = dict(lab.groupBy("__y").count().collect())
    picks = [r for y in (1, 0) for r in lab.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most).collect()]
    counts = _count_all(documents, lab, id_column, text) if max(by_label.values(), default=0) > most else None
    chosen = spark.createDataFrame([(r["__id"], r["__y"]) for r in picks], "__id long, __y int")  # 2 * most rows at most
    rows = documents.select(F.col(f"`{id_column}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id").select("__id", "__text", "__y")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            for lo, hi in chunks(offsets, 2_000_000):
                b = bags(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at = np.searchsorted(b.document, np.arange(hi - lo + 1))
                word = np.searchsorted(b.sentence, at)
                feats = [b.feature[word[k] : word[k + 1]].tobytes() for k in range(hi - lo)]
                sents = [(b.sentence[word[k] : word[k + 1]] - at[k]).astype(np.int32).tobytes() for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(feats, pa.binary()), pa.array(sents, pa.binary())], names=["id", "y", "f", "s"])

    found = arrow_map(rows, featurise, "id long, y int, f binary, s binary").collect()
    found.sort(key=lambda r: (r["id"], r["f"], r["s"]))
    feature, sentence, document, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for k, r in enumerate(found):
        s = np.frombuffer(r["s"], np.int32)
        count = int(s[-1]) + 1 if len(s) else 0
        feature.append(np.frombuffer(r["f"], np.int32))
        sentence.append(s + np.int32(base))
        document.append(np.full(count, k, np.int32))
        base += count
    labels_found = np.array([r["y"] for r in found])
    everything = by_label.get(0, 0) + by_label.get(1, 0)
    del found
    return train(np.concatenate(feature), np.concatenate(sentence), np.concatenate(document), labels_found, by_label.get(1, 0) / everything if everything else None, counts=counts)


def _count_all(documents: DataFrame, lab: DataFrame, id_column: str, text: str) -> Counts | None:
    """Words of all labelled documents; None if they are not of both labels. Cells: hits, misses, then documents of both."""
    texts = documents.select(F.col(f"`{id_column}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    rows = texts.join(lab.hint("shuffle_hash"), "__id").select("__text", "__y")

    def add(array: np.ndarray, batch: pa.RecordBatch) -> None:
        raw, offsets = flat(batch.column(0))
        toxic = batch.column(1).to_numpy().astype(bool)
        for lo, hi in chunks(offsets, 2_000_000):
            b = bags(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            found = count_words(b.feature, b.sentence, b.document, toxic[lo:hi])
            array[:FEATURES] += found.hits
            array[FEATURES:-2] += found.misses
            array[-2:] += (found.toxic, found.clean)

    cells = gather(rows, 2 * FEATURES + 2, "int64", add)
    return Counts(cells[:FEATURES], cells[FEATURES:-2], int(cells[-2]), int(cells[-1])) if cells[-2:].all() else None


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, offending: array of (start, end, p) of the sentences with p >= 0.5, as byte offsets.

    Null and empty texts have no sentences, hence score 0. The model (FEATURES numbers) is broadcast; no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            for lo, hi in chunks(offsets, 2_000_000):
                b = bags(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                minus_log = shared.value.sentences(b)
                total = np.bincount(b.document, minus_log, hi - lo)
                bad = np.flatnonzero(minus_log >= np.log(2))
                at = np.searchsorted(b.document[bad], np.arange(hi - lo + 1))
                values = pa.StructArray.from_arrays([pa.array(b.start[bad]), pa.array(b.end[bad]), pa.array(-np.expm1(-minus_log[bad]))], fields=list(spans.value_type))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
                count = np.bincount(b.document, minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.clip(-np.expm1(-total), 0, 1)), pa.array(count), lists], names=["doc_id", "score", "n_sentences", "offending"])

    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, run, "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,p:double>>")


def reject(documents: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """documents, whole rows and all columns, without those that score `threshold` or more; null and empty texts stay."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def chance(column):
        import pandas as pd

        raw, offsets = flat(pa.array(column, pa.large_string()))
        out = [shared.value.documents(bags(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), hi - lo) for lo, hi in chunks(offsets, 2_000_000)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return documents.where(chance(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) < threshold)
