"""Suffix-array removal of repeated passages.

A byte goes if a string of `length` bytes that covers it also starts earlier (in a smaller doc_id, or further left in
the same document). Finding those strings takes a suffix array with adjacent common prefixes; to spread it over a
cluster, texts are first cut where their content says so:

* Every string of `length` bytes has an anchor, the leftmost of its `gram`-byte pieces with the least hash. Equal
  strings have equal anchors at equal offsets, so a string can only repeat among the contexts of one anchor value: the
  stretch of text whose strings have that anchor. Anchor values that occur once are done; the others pick the contexts
  that a second reading of the texts sends: by a Bloom filter of fixed size, or, if there are more of them than that
  holds, by a join that gives every document its own repeated anchors. What slips through a filter is harmless.
* Contexts are dealt out by anchor value, equal ones are collapsed, and each block is suffix-sorted in two stages:
  suffixes smaller than their successors are sorted directly, all others are induced by scanning the buckets in order.
  Adjacent suffixes that share `length` bytes are one string; whatever occurrence is not its first is removed.
* Anchor values that occur very often (a passage that a third of all documents share) would fill one block. Their
  strings are dealt out singly, so they spread, and a sender names each distinct string once, with its first occurrence
  there. Blocks of them are sorted the same way and give the first occurrence of each string; that table is joined back
  to the senders' strings, whose overlapping spans become one again, so no task ever holds all occurrences of a string.
* Exact copies of a whole document are dropped before all that, by the same sieve: all their bytes go.

A document is a row's id together with its text; `tie`, a 64-bit hash of the text, tells texts of one id apart and orders
them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Bits, Sieve, arrow_map, chunks, cut, flat, fresh, long_of, mix64, packed, sift

LENGTH, GRAM = 100, 24
#: Bytes of contexts in one suffix array and bytes of input for one bucket, about; occurrences from which an anchor is
#: dealt out string by string.
BLOCK, BUCKET, HOT = 1_200_000, 6_000_000, 4000
#: Hashes that a sender counts together.
TOGETHER = 2_000_000
#: Ends a context in a suffix array: no byte of UTF-8.
STOP = 0xFF


# --- anchors ---------------------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes at each place (fewer places than bytes, by gram - 1)."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        level, width, out, done = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
        while True:  # by doubling: bits of `gram` from the low end
            if gram & width:
                out = level[: len(raw)].copy() if out is None else out[: len(raw) - done - width + 1] * np.uint64(pow(base, width, 2**64)) + level[done : len(raw) - width + 1]
                done += width
            if done == gram:
                break
            level = level[:-width] * np.uint64(pow(base, width, 2**64)) + level[width:]
            width *= 2
    return mix64(out[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span : width - span + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per stretch of strings with one anchor: (anchor's hash, first string, last string). Long inputs go in pieces."""
    parts = [_anchors(raw[s : s + most + length - 1], np.unique(np.clip(offsets - s, 0, len(raw[s : s + most + length - 1]))), length, gram, s) for s in range(0, max(len(raw) - length + 1, 1), most)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = gram_hashes(raw, gram)
    place = np.uint64((1 << 24) - 1)
    key = (hashed & ~place) | np.arange(len(hashed), dtype=np.uint64)
    least = sliding_min(key, length - gram + 1)
    whole = np.zeros(n + 1, np.int8)  # strings that end in the text they start in
    size = np.diff(offsets)
    long_enough = size >= length
    whole[offsets[:-1][long_enough]] += 1
    np.subtract.at(whole, offsets[1:][long_enough] - length + 1, 1)
    whole = np.cumsum(whole[:n]) > 0
    new = np.concatenate(([True], (least[1:] != least[:-1]))) | np.concatenate(([True], ~whole[:-1]))
    first = np.flatnonzero(new & whole)
    ends = np.flatnonzero(np.concatenate((new[1:] | ~whole[1:], [True])) & whole)
    at = (least[first] & place).astype(np.int64)
    return hashed[at], first + shift, ends + shift


# --- suffix array ----------------------------------------------------------------------------------------------------


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    out = padded[: len(text)].copy()
    for k in range(1, 8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one a place further right (the last one, larger than nothing, isn't)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1:] = -1
    decided = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return step[decided] > 0


def direct_sort(text: np.ndarray, words: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """The chosen suffixes in the order of their first `depth` bytes (at least)."""
    padded = np.concatenate((words, np.zeros(depth + 16, np.uint64)))
    order = chosen[np.argsort(words[chosen], kind="stable")]
    key = words[order]
    tied = np.concatenate((key[1:] == key[:-1], [False]))
    new = np.concatenate(([True], ~tied[:-1])) if len(order) else np.zeros(0, bool)
    at = 8
    while at < depth and tied.any():
        slots = np.flatnonzero(tied | ~new)  # members of ties
        group = np.cumsum(new[slots]).astype(np.uint64)
        room = 64 - int(group[-1]).bit_length()
        take = min(room // 8, 8) * 8  # bits of text in the key, whole bytes
        sub = order[slots]
        key = (group << np.uint64(take)) | (padded[sub + at] >> np.uint64(64 - take))
        by = np.argsort(key, kind="stable")
        order[slots], key = sub[by], key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[slots] = fresh
        tied = np.zeros(len(order), bool)
        tied[slots[:-1]] = ~fresh[1:]
        at += take // 8
    return order


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes, by two-stage sorting.

    Buckets are scanned from the least first byte: when a bucket is reached, its larger-than-successor suffixes have all
    arrived, in order, from the suffixes that follow them; its directly sorted ones come after. Each place of a finished
    bucket then sends the suffix to its left on, if that one is larger than its successor.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = eight_bytes(text) if words is None else words
    small = smaller_than_next(text)
    direct = direct_sort(text, words, np.flatnonzero(small), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]
    arrived[text[-1]].append(np.array([n - 1]))
    out = []
    for c in np.unique(text).tolist():
        bucket, wave = [], np.concatenate(arrived[c]) if arrived[c] else np.zeros(0, np.int64)
        while len(wave):  # runs of c: those induced within the bucket come after what induced them
            bucket.append(wave)
            left = wave[wave > 0] - 1
            wave = left[(text[left] == c) & ~small[left]]
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        left = done[done > 0] - 1
        left = left[(text[left] > c) & ~small[left]]
        if len(left):
            to = text[left]
            by = np.argsort(to, kind="stable")
            left, to = left[by], to[by]
            edges = np.flatnonzero(np.diff(to)) + 1
            for part in np.split(left, edges):
                arrived[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it, counted up to depth (0 for the first)."""
    shared = np.zeros(len(order), np.int64)
    padded = np.concatenate((words, np.zeros(depth + 8, np.uint64)))
    live = np.arange(1, len(order))
    at = 0
    while at < depth and len(live):
        differ = padded[order[live] + at] ^ padded[order[live - 1] + at]
        same = differ == 0
        odd = differ[~same]
        shared[live[~same]] = at + sum((odd < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        live = live[same]
        at += 8
    shared[live] = depth
    return np.minimum(shared, depth)


# --- blocks of contexts ----------------------------------------------------------------------------------------------


def repeated(text: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, place: np.ndarray, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of what is removed in a block.

    Distinct context k is text[start[k]:start[k] + size[k]]; occurrence o (ascending by doc, place) is of context
    which[o] and starts at `place[o]` of document `doc[o]`.
    """
    k = len(start)
    # block text: the contexts, each with a stop behind
    lengths = size + 1
    begin = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    block = np.full(total, STOP, np.uint8)
    inside = np.ones(total, bool)
    inside[begin + size] = False
    block[inside] = text[np.repeat(start - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(int(size.sum()))]
    words = eight_bytes(block)
    order = suffix_array(block, length, words)
    strings = size - length + 1
    own = np.full(total, -1, np.int64)
    context = np.repeat(np.arange(k), strings)
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(strings)))[:-1], strings) + np.arange(len(context))
    own[at] = np.arange(len(context))
    order = order[own[order] >= 0]
    cls = np.cumsum(common_prefixes(words, order, length) < length) - 1
    number = own[order]
    # the first occurrence of each distinct context, then of each string
    _, first = np.unique(which, return_index=True)
    docs, rank = np.unique(doc, return_inverse=True)
    key = (rank[first][context] << 32) + place[first][context] + (at - begin[context])
    of_class = key[number]
    least = np.minimum.reduceat(of_class, np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))) if len(cls) else of_class
    gone = np.zeros(len(context), bool)
    gone[number] = least[cls] < of_class
    # first occurrences lose the runs of strings that start elsewhere before; all later ones lose everything
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(lo):  # a run may go on into the next context: cut it there
        bounds = np.concatenate(([0], np.cumsum(strings)))
        inner = bounds[1:-1][gone[bounds[1:-1] - 1] & gone[bounds[1:-1]]]
        lo, hi = np.sort(np.concatenate((lo, inner))), np.sort(np.concatenate((hi, inner)))
    c = context[lo]
    off = at[lo] - begin[c]
    later = np.ones(len(which), bool)
    later[first] = False
    w = which[later]
    return (
        np.concatenate((doc[first][c], doc[later])),
        np.concatenate((place[first][c] + off, place[later])),
        np.concatenate((place[first][c] + off + (hi - lo) + length - 1, place[later] + size[w])),
    )


def _context_ids(anchor: np.ndarray, size: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """128-bit names of contexts, so that equal ones collapse."""
    view = memoryview(np.ascontiguousarray(text))
    return np.array([hashlib.blake2b(view[s : s + n], digest_size=16, key=int(a).to_bytes(8, "little")).digest() for a, s, n in zip(anchor.tolist(), start.tolist(), size.tolist(), strict=True)], dtype="V16") if len(size) else np.zeros(0, "V16")


def numbered(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each occurrence's document in their order, doc and tie by number)."""
    order = np.lexsort((tie, doc))
    doc, tie = doc[order], tie[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, doc[new], tie[new]


class Collapsed:
    """Contexts with their occurrences, equal contexts held once."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.anchor: list[int] = []
        self.size: list[int] = []
        self.texts: list[bytes] = []
        self.columns: list[list[np.ndarray]] = [[], [], [], []]

    def add(self, anchor, names, text, start, size, which, doc, tie, place) -> None:
        """Contexts with names, and occurrences `which` of them."""
        to = np.empty(len(size), np.int64)
        view = memoryview(np.ascontiguousarray(text))
        for k, name in enumerate(names.tobytes()[i : i + 16] for i in range(0, 16 * len(names), 16)):
            n = self.number.get(name)
            if n is None:
                n = self.number[name] = len(self.texts)
                self.texts.append(bytes(view[start[k] : start[k] + size[k]]))
                self.anchor.append(int(anchor[k]))
                self.size.append(int(size[k]))
            to[k] = n
        for held, column in zip(self.columns, (to[which].astype(np.int32), doc, tie, place.astype(np.int32)), strict=True):
            held.append(column)

    def blocks(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Removed (doc, tie, from, to), from suffix arrays of about BLOCK bytes; an anchor's contexts stay together."""
        which, doc, tie, place = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in self.columns)
        document, docs, ties = numbered(doc, tie)
        order = np.lexsort((place, document, which))
        which, document, place = which[order].astype(np.int64), document[order], place[order].astype(np.int64)
        # a repeated row of the same document is no earlier occurrence
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (document[1:] != document[:-1]) | (place[1:] != place[:-1])
        which, document, place = which[new], document[new], place[new]
        size = np.array(self.size, np.int64)
        times = np.bincount(which, minlength=len(size))
        starts = np.concatenate(([0], np.cumsum(times)))
        for members in in_blocks(np.array(self.anchor, np.uint64), size, times):
            text = np.frombuffer(b"".join(self.texts[m] for m in members.tolist()), np.uint8)
            own = size[members]
            count = times[members]
            occurs = np.repeat(starts[members] - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(int(count.sum()))
            gone, lo, hi = repeated(text, np.cumsum(own) - own, own, document[occurs], place[occurs], np.repeat(np.arange(len(members)), count), length)
            yield docs[gone], ties[gone], lo, hi


def in_blocks(group: np.ndarray, size: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """Members cut into blocks of about BLOCK bytes that keep groups together; groups that occur once are left out."""
    by = np.argsort(group, kind="stable")
    _, place = np.unique(group[by], return_inverse=True)
    keep = np.bincount(place, times[by])[place] > 1 if len(by) else np.zeros(0, bool)
    by, place = by[keep], place[keep]
    if not len(by):
        return []
    block = (np.cumsum(size[by]) - 1) // BLOCK
    last_of_group = np.concatenate((place[1:] != place[:-1], [True]))
    block = np.maximum.accumulate(block[last_of_group])[np.cumsum(last_of_group) - last_of_group]
    return np.split(by, np.flatnonzero(np.diff(block)) + 1)


class Strings:
    """Distinct strings of `length` bytes by name, each with the first occurrence that any sender told of."""

    def __init__(self, length: int):
        self.length, self.texts, self.parts = length, {}, []

    def add(self, names: bytes, body: bytes, times: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> None:
        for k in range(len(doc)):
            self.texts.setdefault(names[16 * k : 16 * k + 16], body[k * self.length : (k + 1) * self.length])
        self.parts.append((np.frombuffer(names, "V16"), times, doc, tie, place))

    def firsts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(names, doc, tie, place): where each string that repeats starts first."""
        names, times, doc, tie, place = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        document, docs, ties = numbered(doc, tie)
        known, which = np.unique(names, return_inverse=True)
        order = np.lexsort((place, document, which))
        one = order[np.concatenate(([0], np.flatnonzero(np.diff(which[order])) + 1))]
        size = np.full(len(known), self.length, np.int64)
        count = np.bincount(which, times).astype(np.int64)
        for members in in_blocks(np.arange(len(known)), size, count):
            text = np.full(len(members) * (self.length + 1), STOP, np.uint8)
            text.reshape(len(members), -1)[:, : self.length] = np.frombuffer(b"".join(self.texts[known[m].tobytes()] for m in members.tolist()), np.uint8).reshape(len(members), -1)
            words = eight_bytes(text)
            ranked = suffix_array(text, self.length, words)
            ranked = ranked[ranked % (self.length + 1) == 0]
            cls = np.cumsum(common_prefixes(words, ranked, self.length) < self.length) - 1
            m = members[ranked // (self.length + 1)]
            by = np.lexsort((place[one[m]], document[one[m]], cls))  # names of one class, should there be several, have one first
            start = np.concatenate(([0], np.flatnonzero(np.diff(cls[by])) + 1))
            first = one[m[by][start]][cls]
            yield known[m], docs[document[first]], ties[document[first]], place[first]


# --- the distributed operator ----------------------------------------------------------------------------------------


def _body(text: str):
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def _tie(text: str):
    return F.xxhash64(_body(text))


def _texts(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    return documents.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), _tie(text).alias("tie"), _body(text).alias("text"))


def _batches(batches: Iterator[pa.RecordBatch], wanted, own: bool = False):
    """(doc_id, tie, bytes, offsets, each document's own anchors if it brings them) of about a million bytes each."""
    for batch in batches:
        batch = batch.filter(pa.array(wanted(long_of(batch.column(0)))))
        if batch.num_rows:
            raw, offsets = flat(batch.column(2))
            ids, ties = long_of(batch.column(0)), long_of(batch.column(1))
            for lo, hi in chunks(offsets, 1_000_000):
                yield ids[lo:hi], ties[lo:hi], raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], batch.column(3).slice(lo, hi - lo) if own else None


def count_hashes(rows: DataFrame, hashes, buckets: int) -> DataFrame:
    """(h, n): hashes that occur more than once, and how often. Each sender counts TOGETHER of them before it sends, so a
    hash that a third of all documents hold is one number a sender."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            bucket = (value % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            of, begin = np.unique(bucket[order], return_index=True)
            cuts = np.append(begin, len(order))
            # a count that a byte holds is one; the few others follow with their places
            small = np.minimum(times, 255).astype(np.uint8)
            rest = [np.flatnonzero(small[order[a:b]] == 255) for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = (
                [value[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)],
                [small[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)],
                [np.stack((r, times[order[a:b]][r])).astype(np.int64).tobytes() for r, a, b in zip(rest, cuts, cuts[1:], strict=False)],
            )
            return pa.RecordBatch.from_arrays([pa.array(of), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "h", "n", "more"])

        for h in hashes(batches):
            held.append(h)
            size += len(h)
            if size >= TOGETHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def flush() -> pa.RecordBatch:
            value, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            times = np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)
            many = times > 1
            return pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(times[many])], names=["h", "n"])

        for batch in batches:
            for bucket, h, n, more in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if bucket != at and held:
                    yield flush()
                    held = []
                at = bucket
                times = np.frombuffer(n, np.uint8).astype(np.int64)
                place, large = np.frombuffer(more, np.int64).reshape(2, -1)
                times[place] = large
                held.append((np.frombuffer(h, np.uint64), times))
        if held:
            yield flush()

    sent = arrow_map(rows, send, "bucket int, h binary, n binary, more binary")
    return cut(arrow_map(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), count, "h long, n long"))


def removed_spans(texts: DataFrame, reps: DataFrame, total_bytes: int, how_many_reps: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tie, lo, hi): stretches to remove, overlapping ones included, for the texts of the ids in reps."""
    spark = texts.sparkSession
    sieve = Sieve(texts, reps, count=how_many_reps)
    wanted, rows = sieve.test(), sieve.rows
    buckets = max(1, int(total_bytes // BUCKET) + 1)

    def anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, raw, offsets, _ in _batches(batches, wanted):
            yield anchors(raw, offsets, length, gram)[0]

    found = count_hashes(rows, anchor_hashes, buckets)
    how_many, how_hot = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > HOT, 1))).first()
    fits = Bits.fits(how_many)
    if fits:
        many = spark.sparkContext.broadcast(Bits(how_many, probes=3).fill(found.select("h")))
        hot = spark.sparkContext.broadcast(Bits(how_hot, probes=3).fill(found.where(F.col("n") > HOT).select("h")) if how_hot else None)
    else:
        many = hot = None
        rows = _with_own_anchors(rows, wanted, found, length, gram)

    def picked(batches: Iterator[pa.RecordBatch], busy_ones: bool):
        """(ids, ties, raw, offsets, hash, first, last) of repeated anchors: hot ones, or all others."""
        for ids, ties, raw, offsets, own in _batches(batches, wanted, not fits):
            hashed, first, last = anchors(raw, offsets, length, gram)
            if fits:
                keep = many.value.holds(hashed.view(np.int64))
                busy = hot.value.holds(hashed.view(np.int64)) if hot.value is not None else np.zeros(len(hashed), bool)
            else:
                keep, busy = _own(own, hashed, np.searchsorted(offsets, first, side="right") - 1)
            keep &= busy == busy_ones
            if keep.any():
                yield ids, ties, raw, offsets, hashed[keep], first[keep], last[keep]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ties, raw, offsets, hashed, first, last in picked(batches, False):
            of = np.searchsorted(offsets, first, side="right") - 1
            size = last - first + length
            names = _context_ids(hashed, size, raw, first)
            bucket = (mix64(hashed) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            made = []
            for group in np.split(order, edges):
                distinct, one, which = np.unique(names[group], return_index=True, return_inverse=True)
                g = group[one]
                body = b"".join(raw[first[k] : first[k] + size[k]].tobytes() for k in g.tolist())
                made.append((int(bucket[group[0]]), distinct.tobytes(), hashed[g].tobytes(), size[g].astype(np.int32).tobytes(), body, which.astype(np.int32).tobytes(), ids[of[group]].tobytes(), ties[of[group]].tobytes(), (first[group] - offsets[of[group]]).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], pa.binary() if k else pa.int32()) for k in range(9)], names=["bucket", *_FIELDS])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = Collapsed(), None
        for batch in batches:
            for bucket, names, hashed, size, body, which, doc, tie, place in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                if bucket != at and at is not None:
                    yield from map(_spans, held.blocks(length))
                    held = Collapsed()
                at = bucket
                own = np.frombuffer(size, np.int32).astype(np.int64)
                held.add(np.frombuffer(hashed, np.uint64), np.frombuffer(names, "V16"), np.frombuffer(body, np.uint8), np.cumsum(own) - own, own, np.frombuffer(which, np.int32), np.frombuffer(doc, np.int64), np.frombuffer(tie, np.int64), np.frombuffer(place, np.int32))
        if at is not None:
            yield from map(_spans, held.blocks(length))

    sent = arrow_map(rows, contexts, "bucket int, " + ", ".join(f"{f} binary" for f in _FIELDS))
    spans = arrow_map(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), sort, _SPANS)
    return spans.unionByName(_hot_spans(rows, picked, buckets, length)) if how_hot else spans


def _hot_spans(rows: DataFrame, picked, buckets: int, length: int) -> DataFrame:
    """Spans of the strings whose anchors are hot: one span a string."""
    spark = rows.sparkSession

    def strings(batches: Iterator[pa.RecordBatch]):
        """(ids, ties, raw, offsets, hash of each string, where it starts)."""
        for ids, ties, raw, offsets, _, first, last in picked(batches, True):
            n = last - first + 1
            start = np.repeat(first - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
            yield ids, ties, raw, offsets, gram_hashes(raw, length)[start], start

    found = count_hashes(rows, lambda batches: (s[4] for s in strings(batches)), buckets)
    how_many = found.count()
    many = spark.sparkContext.broadcast(Bits(how_many, probes=3).fill(found.select("h")) if Bits.fits(how_many) else None)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct strings of a chunk of texts for a bucket, with their first occurrences; and, without a bucket, each distinct
        string with all its occurrences in the chunk."""
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 24
        for ids, ties, raw, offsets, hashed, start in strings(batches):
            chunk += 1
            if many.value is not None:
                keep = many.value.holds(hashed.view(np.int64))
                hashed, start = hashed[keep], start[keep]
            if not len(start):
                continue
            of = np.searchsorted(offsets, start, side="right") - 1
            view = memoryview(np.ascontiguousarray(raw))
            names = np.frombuffer(b"".join(hashlib.blake2b(view[s : s + length], digest_size=16).digest() for s in start.tolist()), "V16")
            doc, tie, place = ids[of], ties[of], start - offsets[of]
            known, which, times = np.unique(names, return_inverse=True, return_counts=True)
            order = np.lexsort((place, tie, doc, which))
            one = order[np.concatenate(([0], np.flatnonzero(np.diff(which[order])) + 1))]
            bucket = (hashed[one] % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            made = [(int(bucket[g[0]]), known[g].tobytes(), b"".join(bytes(view[s : s + length]) for s in start[one[g]].tolist()), times[g].astype(np.int64).tobytes(), doc[one[g]].tobytes(), tie[one[g]].tobytes(), place[one[g]].astype(np.int32).tobytes()) for g in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)]
            none, number = pa.nulls(len(made), pa.binary()), pa.nulls(len(made), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int32()), *(pa.array([r[k] for r in made], pa.binary()) for k in range(1, 7)), number, number, number, none, none, none], names=_DEALT)
            hi, lo = np.ascontiguousarray(known).view(np.int64).reshape(-1, 2).T
            bounds = np.concatenate(([0], np.cumsum(times)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(known), pa.int32()), *[pa.nulls(len(known), pa.binary())] * 6, pa.array(np.full(len(known), chunk)), pa.array(np.ascontiguousarray(hi)), pa.array(np.ascontiguousarray(lo)), *(packed(c[order].astype(np.int64), bounds) for c in (doc, tie, place))], names=_DEALT)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = Strings(length), None

        def flush() -> Iterator[pa.RecordBatch]:
            for names, doc, tie, place in held.firsts():
                hi, lo = np.ascontiguousarray(names).view(np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c.astype(np.int64))) for c in (hi, lo, doc, tie, place)], names=["hi", "lo", "first_doc", "first_tie", "first_place"])

        for batch in batches:
            for bucket, names, body, times, doc, tie, place in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if bucket != at and at is not None:
                    yield from flush()
                    held = Strings(length)
                at = bucket
                held.add(names, body, np.frombuffer(times, np.int64), np.frombuffer(doc, np.int64), np.frombuffer(tie, np.int64), np.frombuffer(place, np.int32).astype(np.int64))
        if at is not None:
            yield from flush()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of all occurrences but the first. Strings of a chunk come together, so those that overlap are one span."""
        for batch in batches:
            (doc, offsets), (tie, _), (at, _) = (flat(batch.column(c)) for c in range(3))
            doc, tie, at = (np.frombuffer(c.tobytes(), np.int64) for c in (doc, tie, at))
            first = [np.repeat(long_of(batch.column(c)), np.diff(offsets) // 8) for c in (3, 4, 5)]
            gone = np.flatnonzero((doc != first[0]) | (tie != first[1]) | (at != first[2]))
            if not len(gone):
                continue
            gone = gone[np.lexsort((at[gone], tie[gone], doc[gone]))]
            doc, tie, at = doc[gone], tie[gone], at[gone]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > at[:-1] + length)))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1
            yield _spans((doc[begin], tie[begin], at[begin], at[end] + length))

    dealt = cut(arrow_map(rows, deal, "bucket int, " + ", ".join(f"{c} binary" for c in _DEALT[1:7]) + ", chunk long, hi long, lo long, docs binary, doc_ties binary, places binary"))
    distinct = dealt.where("bucket is not null").select(*_DEALT[:7])
    # a table of its own: a join of two plain exchanges, of which Spark can split a string of any number of occurrences
    firsts = cut(arrow_map(distinct.repartition(buckets, "bucket").sortWithinPartitions("bucket"), sort, "hi long, lo long, first_doc long, first_tie long, first_place long"))
    met = dealt.where("bucket is null").select("chunk", "hi", "lo", "docs", "doc_ties", "places").join(firsts, ["hi", "lo"])
    by_chunk = met.select("chunk", "docs", "doc_ties", "places", "first_doc", "first_tie", "first_place").repartition(buckets, "chunk").sortWithinPartitions("chunk")
    return arrow_map(by_chunk.drop("chunk"), later, _SPANS)


def _with_own_anchors(rows: DataFrame, wanted, found: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, tie, text, own: for more repeated anchors than a filter holds, each document's own (hash and whether it is
    hot, as a list of longs: the hash, last bit replaced), by joins. Documents without any are left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ties, raw, offsets, _ in _batches(batches, wanted):
            hashed, first, _last = anchors(raw, offsets, length, gram)
            of = np.searchsorted(offsets, first, side="right") - 1
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(ids[of]), pa.array(ties[of])], names=["h", "doc_id", "tie"])

    mark = F.col("h").bitwiseAND(F.lit(-2)).bitwiseOR((F.col("n") > HOT).cast("long"))
    held = arrow_map(rows, emit, "h long, doc_id long, tie long").join(found, "h").groupBy("doc_id", "tie").agg(F.collect_set(mark).alias("own"))
    return rows.join(cut(held), ["doc_id", "tie"]).select("doc_id", "tie", "text", "own")


def _own(own: pa.Array, hashed: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, hot) for anchors of the documents `of`, from the documents' own lists."""
    values, sizes = own.flatten().to_numpy().view(np.uint64), np.diff(np.asarray(own.offsets))
    owner = np.repeat(np.arange(len(own)), sizes)
    scramble = lambda h, o: mix64(mix64(h >> np.uint64(1)) + o.astype(np.uint64))  # noqa: E731 - what collides slips through
    known = scramble(values, owner)
    order = np.argsort(known)
    known, is_hot = known[order], (values[order] & np.uint64(1)) == 1
    asked = scramble(hashed, of)
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    there = known[at] == asked if len(known) else np.zeros(len(asked), bool)
    return there, there & is_hot[at] if len(known) else there


def _spans(made: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in made], names=["doc_id", "tie", "lo", "hi"])


_FIELDS = ("names", "hashed", "size", "body", "which", "doc", "ties", "place")
_DEALT = ["bucket", "names", "body", "times", "doc", "ties", "place", "chunk", "hi", "lo", "docs", "doc_ties", "places"]
_SPANS = "doc_id long, tie long, lo long, hi long"


def find_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sums, parts, copies): doc_id, n_bytes and sha of every row; doc_id, tie and spans (lo, hi) of documents that lose
    something; doc_id, tie and sha of documents that repeat an earlier one as a whole."""
    ids = F.col(f"`{id_column}`").cast("long")
    sums = cut(documents.select(ids.alias("doc_id"), _tie(text).alias("tie"), F.octet_length(_body(text)).cast("long").alias("n_bytes"), F.sha2(_body(text), 256).alias("sha")))
    named = sums.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull())
    # a table of its own: a join of two plain exchanges, of which Spark can split a class of copies of any size
    first = cut(named.groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("rep")))
    reps, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    spans = removed_spans(_texts(documents, id_column, text), first.select("rep"), total, reps, length, gram)
    parts = cut(spans.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")))
    copies = named.join(first, ["sha", "n_bytes"]).where("doc_id > rep").select("doc_id", "tie", "sha").distinct()
    return sums, parts, copies


def cut_spans(raw: np.ndarray, spans: pa.StructArray) -> tuple[bytes, int]:
    """(what is left of a text without its spans, how many runs went)."""
    if not len(spans):
        return raw.tobytes(), 0
    lo, hi = spans.field("lo").to_numpy(), spans.field("hi").to_numpy()
    upto = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > upto[:-1]))
    lo, hi = lo[new], upto[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hi) - 1]))]
    edges = [0, *np.stack((lo, hi), 1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)), len(lo)


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of documents.

    Null texts count as empty and lose nothing, like all texts of fewer than `length` bytes. Rows with a null id come
    back with nothing removed. Rows that repeat an id and its text are the same document and never earlier than each
    other; rows that repeat an id with another text are documents of their own, of which that with the smaller
    xxhash64 of its text is the earlier one. Texts of any length are cut into pieces for sorting. Other columns are not
    read, whatever their names; an empty table gives none. Kept texts are put together only for documents that lose
    something but not all; the driver holds counts and Bloom filters of fixed size (16 MB at most).
    """
    sums, parts, copies = find_repeats(documents, id_column, text, length, gram)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            out = []
            for k in range(batch.num_rows):
                own = raw[offsets[k] : offsets[k + 1]]
                kept, n = cut_spans(own, batch.column(2)[k].values)
                out.append((hashlib.sha256(own).hexdigest(), len(own) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "sha", "n_removed", "n_spans", "kept_sha256"])

    some = sift(_texts(documents, id_column, text), parts.select("doc_id")).join(parts, ["doc_id", "tie"]).select("doc_id", "text", "spans")
    changed = arrow_map(some, put_together, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "sha"])
    joined = sums.join(copies.select("doc_id", "sha", F.lit(True).alias("copy")), ["doc_id", "sha"], "left").join(changed, ["doc_id", "sha"], "left")
    whole = F.coalesce("copy", F.lit(False))
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def drop_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """documents, all rows and columns, with repeated bytes taken out of the text (a code point that loses a byte goes
    too); n_chars, if there is one, follows the new text. Rows, ids and texts are read as in `remove_repeats`: rows with a
    null id and short or null texts come back as they are, a copy comes back with an empty text. Columns of any name stay."""
    _, parts, copies = find_repeats(documents, id_column, text, length, gram)
    own_id, own_tie, spans, copy, new = fresh(documents.columns, "id", "tie", "spans", "copy", "new")
    table = cut(parts.join(copies.select("doc_id", "tie", F.lit(True).alias("whole")), ["doc_id", "tie"], "full").select(F.col("doc_id").alias(own_id), F.col("tie").alias(own_tie), F.col("spans").alias(spans), F.coalesce("whole", F.lit(False)).alias(copy)))

    @F.pandas_udf("string")
    def kept(column, pairs):
        import pandas as pd

        out = []
        for t, own in zip(column, pairs, strict=True):
            lo, hi = (pa.array([int(x[k]) for x in own], pa.int64()) for k in ("lo", "hi"))
            out.append(cut_spans(np.frombuffer(t.encode(), np.uint8), pa.StructArray.from_arrays([lo, hi], ["lo", "hi"]))[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    touched = sift(documents, table.select(own_id), id_column)
    untouched = sift(documents, table.select(own_id), id_column, inside=False)
    met = touched.join(table, (F.col(f"`{id_column}`").cast("long") == F.col(own_id)) & (_tie(text) == F.col(own_tie)), "left")
    loses, none = F.col(own_id).isNotNull(), F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    some = loses & ~F.coalesce(F.col(copy), F.lit(False))
    cleaned = kept(F.when(some, _body(text)).otherwise(F.lit("")), F.when(some, F.col(spans)).otherwise(none))
    done = met.withColumn(new, F.when(some, cleaned).when(loses, F.lit("")).otherwise(F.col(f"`{text}`").cast("string")))
    out = []
    for c in documents.columns:
        if c == text:
            out.append(F.col(new).cast(documents.schema[c].dataType).alias(c))
        elif c == "n_chars":
            out.append(F.when(loses, F.char_length(new).cast(documents.schema[c].dataType)).otherwise(F.col("`n_chars`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return untouched.unionByName(done.select(*out))
