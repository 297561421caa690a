"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its k-word shingles. Two sets whose Jaccard similarity reaches t share a token among the
n - ceil(t n) + 1 first tokens of each, under every global order of the tokens. All orders here go by the number of
documents that hold a token, rare ones first, and differ in the hash that orders equals. One order feeds an inverted
index over the prefixes; the pairs it finds must also share a prefix token under each of the other orders before they
are verified exactly on the whole sets. Filters are as sharp as the sets' sizes allow: similarity t needs an overlap of
o = t (na + nb) / (1 + t), so at most n - o tokens of a set are not shared; the first shared token stands no later than
that in both, and prefixes of p tokens share at least p - (n - o) of them.

Document counts are exact and over the whole corpus. Tokens are dealt out by value with the number of the chunk of
documents that they come from; what occurs once ends there, everything else goes back to its chunk with its count.
As tokens of one document come first in every order, a document whose prefix is made of them alone has no partners and
takes no further part; that is nearly every document without near copies. Tokens that are very frequent within chunks
(a line that a third of all documents share) are agreed on first and never dealt out: they come last in every order.

Copies (equal sets) form classes first and one member of each goes on. Clusters are what is asked for, so pairs inside
an already connected component need no check: first each token's members are verified against one hub, then only
members of different components against each other. The index is a table of postings: hubs come from an aggregate that
combines before its shuffle, members meet their hub in a join that may split a token, and the squares of TOGETHER members
in which a token's members of different components meet are dealt out singly. No task holds a token's members.

Words are named by a BLAKE2 digest, so sets are equal or alike only if their words are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnp import digest_runs, lower_ascii, words
from .util import Sieve, arrow_map, chunks, cut, flat, label_components, long_of, mix64, packed, sift

#: Salts of the token orders, the first one's being indexed.
SALTS = (0x51, 0xA3, 0xE7)
#: Tokens that one bucket holds, about; members of a token in one block of its squares; bytes of text in a chunk.
BUCKET, TOGETHER, CHUNK = 1_500_000, 2048, 2_000_000
#: A token is frequent in a chunk if this share of its documents (and at least so many) hold it; how many frequent
#: tokens are agreed on at most (a bound of what is broadcast: 0.8 MB), those of the most documents.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 1 / 16, 64, 100_000
#: Bits of a token in the index. Fewer bits only make candidates that verification drops.
SHORT = 40


@dataclass(frozen=True)
class Jaccard:
    """k-word shingles linked when 100 * intersection >= percent * union."""

    k: int = 5
    percent: int = 80

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Length of the prefix; at least one token of it is shared by any set similar enough."""
        return np.where(n > 0, n + (-self.percent * n) // 100 + 1, 0)

    def overlap(self, a, b):
        """Common tokens that sets of a and b tokens need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def in_prefix(self, a, b):
        """Common tokens that their prefixes need, under any order."""
        need = self.overlap(a, b)
        return np.maximum(np.minimum(self.prefix(a) - (a - need), self.prefix(b) - (b - need)), 1)

    def least_overlap(self, a: Column, b: Column) -> Column:
        """`overlap` of two columns of sizes."""
        return F.call_function("div", self.percent * (a + b) + F.lit(99 + self.percent), F.lit(100 + self.percent))

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def fit(self, one: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
        """Whether two postings (n, place) of a token may belong to sets that are similar enough."""
        a, b = one("n"), other("n")
        need = self.least_overlap(a, b)
        return (100 * F.least(a, b) >= self.percent * F.greatest(a, b)) & (one("place") <= a - need) & (other("place") <= b - need)


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit tokens, ascending and distinct within each text; where each text's tokens start and the last end).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than k words has one token
    for all of them; without words it has none.
    """
    low = lower_ascii(raw)
    start, end, text = words(low, offsets)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    word = digest_runs(low, start, end)
    first = np.concatenate(([0], np.cumsum(count)))
    width = np.minimum(count, k)
    tokens = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    of = np.repeat(np.arange(n), tokens)
    begin = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(tokens)))[:-1], tokens) + first[of]
    with np.errstate(over="ignore"):
        value = width[of].astype(np.uint64)
        for j in range(k):
            on = width[of] > j
            value[on] = mix64(value[on] * np.uint64(0x9FB21C651E98DF25) + word[begin[on] + j])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=n))))


def _rows(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    return documents.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _parts(batches: Iterator[pa.RecordBatch], k: int, wanted=None):
    for batch in batches:
        if wanted is not None:
            batch = batch.filter(pa.array(wanted(long_of(batch.column(0)))))
        if not batch.num_rows:
            continue
        raw, offsets = flat(batch.column(1))
        ids = long_of(batch.column(0))
        for lo, hi in chunks(offsets, CHUNK):
            yield ids[lo:hi], *shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes of the least width that holds them; high planes of zeros compress away."""
    width = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    return bytes([width]) + np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)


def frequent_tokens(made: DataFrame) -> np.ndarray:
    found = made.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "s1").limit(FREQUENT_MOST).select("s1").collect()
    return np.sort(np.array([r["s1"] for r in found], np.int64).view(np.uint64))


def _within(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def features(rows: DataFrame, how: Jaccard) -> DataFrame:
    """kind 0: doc_id, n (size of the set), s1, s2 (equal sets have equal ones). kind 1: a frequent token s1 of a chunk
    and in how many (n) of its documents it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, bounds in _parts(batches, how.k):
            n = np.diff(bounds)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                s1[some] = np.add.reduceat(mix64(tokens), bounds[some])
                s2[some] = np.add.reduceat(mix64(tokens ^ np.uint64(0x5DEECE66D)), bounds[some])
            yield _record(np.zeros(len(n), np.int32), ids, n, s1.view(np.int64), s2.view(np.int64))
            least = max(FREQUENT_LEAST, int(len(some) * FREQUENT_SHARE))
            if len(some) > least:
                value, count = np.unique(tokens, return_counts=True)
                value, count = value[count >= least], count[count >= least]
                zeros = np.zeros(len(value), np.int64)
                yield _record(np.ones(len(value), np.int32), zeros, count, value.view(np.int64), zeros)

    def _record(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c.astype(np.int64)) for c in columns[1:])], names=["kind", "doc_id", "n", "s1", "s2"])

    return arrow_map(rows, run, "kind int, doc_id long, n long, s1 long, s2 long")


def prefixes(sieve: Sieve, total: int, frequent: np.ndarray, how: Jaccard) -> DataFrame:
    """doc, n, own (tokens that no other document holds: they come first) and for each order k the prefix tokens that
    other documents hold too (`p0`, `p1`, ...; binary), for the documents that have any. `total`: tokens of all documents that the sieve holds, about."""
    buckets = max(1, int(total // BUCKET) + 1)
    wanted, often = sieve.test(), sieve.rows.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 24  # the same in every attempt of a task
        for ids, tokens, bounds in _parts(batches, how.k, wanted):
            n = np.diff(bounds)
            of = np.repeat(np.arange(len(n)), n)
            last = _within(tokens, often.value)
            at = np.concatenate(([0], np.cumsum(np.bincount(of[last], minlength=len(n)))))
            short = tokens >> np.uint64(64 - SHORT)
            yield _row([chunk % buckets], [1], [chunk], [ids.tobytes()], [n.astype(np.int32).tobytes()], [at.astype(np.int32).tobytes() + short[last].tobytes()])
            short, of = short[~last], of[~last]
            order = np.argsort(short, kind="stable")
            short, of = short[order], of[order]
            bucket = ((short * np.uint64(buckets)) >> np.uint64(SHORT)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts)).tolist()
            if some:
                first = [int(short[cuts[b]]) for b in some]
                yield _row(some, [0] * len(some), [chunk] * len(some), [np.int64(f).tobytes() for f in first], [_planes(np.diff(short[cuts[b] : cuts[b + 1]])) for b in some], [_planes(of[cuts[b] : cuts[b + 1]]) for b in some])
            chunk += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None
        for batch in batches:
            for bucket, kind, *row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if bucket != at and held:
                    yield from counted(held)
                    held = []
                at = bucket
                if kind == 1:
                    yield _row([bucket], [1], *([x] for x in row))
                else:
                    held.append(row)
        if held:
            yield from counted(held)

    def counted(held: list) -> Iterator[pa.RecordBatch]:
        tokens = [np.cumsum(np.concatenate(([np.frombuffer(r[1], np.int64)[0]], _from_planes(r[2]).astype(np.int64)))).astype(np.uint64) for r in held]
        size = np.array([len(t) for t in tokens])
        tokens = np.concatenate(tokens)
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(ordered)))
        counts = np.empty(len(tokens), np.int64)
        counts[order] = np.repeat(times, times)
        ends = np.cumsum(size)
        out: list[list] = [[], [], []]
        for row, lo, hi in zip(held, (ends - size).tolist(), ends.tolist(), strict=True):
            many = np.flatnonzero(counts[lo:hi] > 1)
            if len(many):
                own = tokens[lo:hi][many]
                out[0].append(row[0])
                out[1].append(_planes(_from_planes(row[3])[many]))
                out[2].append(_planes(counts[lo:hi][many]) + own.tobytes())
        if out[0]:
            yield _row([0] * len(out[0]), [0] * len(out[0]), out[0], [b""] * len(out[0]), out[1], out[2])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, of, tokens, counts = None, None, [], [], []
        for batch in batches:
            for _, kind, chunk, a, b, c in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if chunk != at and table is not None:
                    yield from chosen(table, of, tokens, counts)
                    table, of, tokens, counts = None, [], [], []
                at = chunk
                if kind == 1:
                    table = (np.frombuffer(a, np.int64), np.frombuffer(b, np.int32).astype(np.int64), c)
                else:
                    own = _from_planes(b)
                    of.append(own)
                    tokens.append(np.frombuffer(c, np.uint64, offset=len(c) - 8 * len(own)))
                    counts.append(_from_planes(c[: len(c) - 8 * len(own)]))
        if table is not None:
            yield from chosen(table, of, tokens, counts)

    def chosen(table, of: list, tokens: list, counts: list) -> Iterator[pa.RecordBatch]:
        ids, n, tail = table
        starts = np.frombuffer(tail, np.int32, len(ids) + 1).astype(np.int64)
        last = np.frombuffer(tail, np.uint64, offset=4 * (len(ids) + 1)) if starts[-1] else np.zeros(0, np.uint64)
        of = np.concatenate([*of, np.repeat(np.arange(len(ids)), np.diff(starts)).astype(np.uint64)]).astype(np.int64)
        tokens = np.concatenate([*tokens, last])
        counts = np.concatenate([*counts, np.full(len(last), 1 << 62, np.uint64)])
        shared = np.bincount(of, minlength=len(ids))
        take = np.maximum(how.prefix(n) - (n - shared), 0)  # tokens of one document come first
        keep = take[of] > 0
        of, tokens, counts = of[keep], tokens[keep], counts[keep]
        chosen_ = np.flatnonzero(take > 0)
        if not len(chosen_):
            return
        bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ids)))))
        columns = []
        for salt in SALTS:
            order = np.lexsort((mix64(tokens ^ np.uint64(salt)), counts, of))
            rank = np.arange(len(order)) - bounds[of[order]]
            picked = order[rank < take[of[order]]]
            columns.append(packed(tokens[picked], np.concatenate(([0], np.cumsum(take[chosen_])))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[chosen_]), pa.array(n[chosen_]), pa.array((n - shared)[chosen_]), *columns], names=["doc", "n", "own", *_PREFIXES])

    def _row(*columns) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "chunk", "a", "b", "c"])

    schema = "bucket int, kind int, chunk long, a binary, b binary, c binary"
    dealt = arrow_map(arrow_map(sieve.rows, deal, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket"), count, schema)
    back = dealt.repartition(max(buckets, 1), "chunk").sortWithinPartitions("chunk", F.col("kind").desc())
    return arrow_map(back, choose, "doc long, n long, own long, " + ", ".join(f"{p} binary" for p in _PREFIXES))


_PREFIXES = [f"p{k}" for k in range(len(SALTS))]


def join_components(documents: DataFrame, how: Jaccard, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    Null texts and texts without words have no shingles and stand alone. Rows with a null id take no part. An id that
    repeats is one node: a link of any of its rows counts. Equal sets are linked whatever their texts. Other columns
    are not read, whatever their names; an empty table gives none; texts of any length are read whole. What is broadcast
    has a fixed size: frequent tokens and Bloom filters (16 MB at most) that only spare work; more keys than those hold are
    joined. No group is ever collected: pairs of a token are formed in squares of TOGETHER members.
    """
    rows = _rows(documents, id_column, text)
    made = cut(features(rows, how))
    some = made.where("kind = 0 and n > 0")
    classes = cut(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    reps, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = cut(prefixes(Sieve(rows, classes.select("rep"), count=reps), total, frequent_tokens(made), how))

    # 1: hubs
    index = _index(held, how)
    hubs = cut(index.groupBy("token").agg(F.min(F.struct("doc", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").select("token", "hub"))
    met = index.join(hubs, "token").where((F.col("doc") != F.col("hub.doc")) & how.fit(F.col, lambda c: F.col(f"hub.{c}")))
    pairs = cut(_pairs_of(met, F.col("doc"), F.col("hub.doc")))
    links = cut(_verified(rows, pairs, held, how))
    roots = label_components(links)
    # 2: members of different components that still share a token
    across = cut(_across(index, roots, how).join(pairs, ["a", "b"], "left_anti"))
    if across.limit(1).count():
        more = cut(_verified(rows, across, held, how))
        if more.limit(1).count():
            roots = label_components(links.union(more))
    of_class = classes.join(roots, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    member = some.select("doc_id", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return member.unionByName(made.where("kind = 0 and n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _index(held: DataFrame, how: Jaccard) -> DataFrame:
    """token, doc, n, place: the prefix tokens of the first order, without members that stand too late for even the
    smallest partner in reach, and without tokens that one document has."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(2))
            count = np.diff(offsets) // 8
            place = np.repeat(long_of(batch.column(3)) - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            columns = [np.frombuffer(raw.tobytes(), np.int64), *(np.repeat(long_of(batch.column(c)), count) for c in (0, 1)), place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "doc", "n", "place"])

    postings = cut(arrow_map(held.select("doc", "n", "p0", "own"), post, "token long, doc long, n long, place long"))
    least = cut(postings.groupBy("token").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1").select("token", "least"))
    n = F.col("n")
    reach = F.greatest(F.col("least"), F.call_function("div", how.percent * n + 99, F.lit(100)))
    early = F.col("place") <= n - how.least_overlap(n, reach)
    return cut(postings.join(least, "token").where(early).select("token", "doc", "n", "place"))


def _pairs_of(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _across(index: DataFrame, roots: DataFrame, how: Jaccard) -> DataFrame:
    """Candidate pairs a < b of different components, from every token whose members lie in several."""
    named = cut(index.join(roots.distinct(), F.col("doc") == F.col("node"), "left").select("token", "doc", "n", "place", F.coalesce("root", "doc").alias("comp")))
    mixed = cut(named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("members")).where("x <> y").select("token", F.ceil(F.col("members") / TOGETHER).cast("int").alias("blocks")))
    # a token's members lie in blocks; each pair of blocks is a square of its own
    blocked = named.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    member = F.struct("doc", "n", "place", "comp")
    left = blocked.select("token", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), member.alias("l"))
    right = blocked.select("token", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), member.alias("r"))
    once = (F.col("i") < F.col("j")) | (F.col("l.doc") < F.col("r.doc"))
    met = left.join(right, ["token", "i", "j"]).where((F.col("l.comp") != F.col("r.comp")) & (F.col("l.doc") != F.col("r.doc")) & once & how.fit(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}")))
    return _pairs_of(met, F.col("l.doc"), F.col("r.doc"))


def _verified(rows: DataFrame, pairs: DataFrame, held: DataFrame, how: Jaccard) -> DataFrame:
    """The pairs that pass the other orders' filters and whose similarity, counted on the whole sets, is high enough."""
    others = _PREFIXES[1:]
    side = lambda name: held.select(F.col("doc").alias(name), F.struct("n", *others).alias(f"{name}_prefix"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_prefix", "b_prefix")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that share enough prefix tokens under every other order."""
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            need = how.in_prefix(*(long_of(batch.column(c).field("n")) for c in (2, 3)))
            for p in others:
                left, right = batch.column(2).field(p), batch.column(3).field(p)
                for i in np.flatnonzero(keep).tolist():
                    keep[i] = _common(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)) >= need[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = cut(arrow_map(met, intersect, "a long, b long").distinct())
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    sieve = Sieve(rows, ids)  # what slips through joins nothing
    wanted = sieve.test()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids_, tokens, bounds in _parts(batches, how.k, wanted):
            yield pa.RecordBatch.from_arrays([pa.array(ids_), packed(tokens, bounds)], names=["id", "tokens"])

    whole = cut(arrow_map(sieve.rows, sets, "id long, tokens binary"))
    of = lambda name: whole.select(F.col("id").alias(name), F.col("tokens").alias(f"{name}_set"))
    both = left.join(of("b"), "b").join(of("a"), "a").select("a", "b", "a_set", "b_set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                keep[i] = how.linked(_common(s, t), len(s), len(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return arrow_map(both, verify, "a long, b long").distinct()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two arrays without repetitions."""
    both = np.sort(np.concatenate((a, b)))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def drop_near_copies(documents: DataFrame, how: Jaccard = Jaccard(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """documents, whole rows and all columns, with one document of each component: the smallest id. Rows with a null id and
    texts without words stay; rows that repeat an id stay or go together; columns of any name stay."""
    groups = join_components(documents, how, id_column, text)
    gone = cut(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return sift(documents, gone, id_column, inside=False)
