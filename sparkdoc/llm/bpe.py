"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces (pattern matches) of a batch of documents form one corpus of byte sequences. An inverted index
from pair to positions, keyed by the rank of the token that the pair makes, says where each merge applies; merges are
replayed in rank order over the whole corpus, and each touches only the two neighbours of a merged position, whose new
pairs enter the index. A merge that makes a pair of a lower rank postpones the rest of that piece, so every piece ends
up as it would alone: always its lowest-ranked pair first, the leftmost of equals.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_map, trim

#: Distinct pieces whose ids a worker remembers between batches.
REMEMBERED = 300_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: one token (base64) and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Replay:
    """Ranks made ready for replay. Every single byte needs a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = np.fromiter((x for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]], ranks[t[k:]], r)), np.int64)
        left, right, rank = made[::3], made[1::3], made[2::3]
        self.shift = max(1, int(max(ranks.values())).bit_length())
        order = np.argsort(left << self.shift | right, kind="stable")
        self.keys, self.ranks = (left << self.shift | right)[order], rank[order].astype(np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, NONE if none."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, where each piece starts and the last ends)."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.concatenate(([0], np.cumsum(length)))
        n = int(start[-1])
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), length)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        some = start[:-1][length > 0]
        before[some] = -1
        after[start[1:][length > 0] - 1] = -1
        pair = np.full(n, NONE, np.int32)  # rank of the pair that starts here
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.rank_of(token[inner], token[inner + 1])
        alive = np.ones(n, bool)
        self._replay(token, piece, after, before, pair, alive)
        kept = np.concatenate(([0], np.cumsum(alive)))
        return token[alive], kept[start]

    def _replay(self, token, piece, after, before, pair, alive) -> None:
        todo = np.flatnonzero(pair != NONE)
        todo = todo[np.argsort(pair[todo], kind="stable")]
        of_rank, first = np.unique(pair[todo], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(of_rank, np.split(todo, first[1:]), strict=True)} if len(todo) else {}
        heap = list(index)
        heapq.heapify(heap)

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            pair[at] = ranks
            at, ranks = at[ranks != NONE], ranks[ranks != NONE]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edges = np.flatnonzero(np.diff(ranks)) + 1
            for r, places in zip(ranks[np.concatenate(([0], edges))].tolist(), np.split(at, edges) if len(edges) else [at], strict=True):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(heap, r)

        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = np.unique(at[(pair[at] == r) & alive[at]])
            if not len(at):
                continue
            if len(at) > 1:
                at = self._together(r, at, token, piece, after, before, index, heap)
            gone = after[at]
            right = after[gone]
            token[at] = r
            after[at] = right
            alive[gone] = False
            pair[gone] = NONE
            pair[at] = NONE
            r_ok = right >= 0
            before[right[r_ok]] = at[r_ok]
            left = before[at]
            l_ok = left >= 0
            enter(at[r_ok], self.rank_of(token[at[r_ok]], token[right[r_ok]]))
            enter(left[l_ok], self.rank_of(token[left[l_ok]], token[at[l_ok]]))

    def _together(self, r, at, token, piece, after, before, index, heap) -> np.ndarray:
        """Of the places of rank r those that may be merged at once; what has to wait goes back into the index."""
        every = at
        chained = at[1:] == after[at[:-1]]
        if chained.any():  # overlapping pairs: every other one, from the left
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), k, 0))) % 2 == 0]
        same = piece[at[1:]] == piece[at[:-1]]
        if not same.any():
            return at
        # a piece with several merges whose new pairs rank below r must take them one by one
        gone = after[at]
        right, left = after[gone], before[at]
        merged = np.full(len(at), r, np.int64)
        lower = (right >= 0) & (self.rank_of(merged, token[right]) < r)
        follows = np.concatenate(([False], left[1:] == gone[:-1]))
        lower |= (left >= 0) & (self.rank_of(np.where(follows, r, token[left]), merged) < r)
        if lower.any():
            slow = np.isin(piece[every], piece[at[lower]])
            first = np.concatenate(([True], piece[every[1:]] != piece[every[:-1]]))
            index[r] = [every[slow & ~first]]
            heapq.heappush(heap, r)
            at = at[~np.isin(at, every[slow & ~first])]
        return at

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Numbering(dict):
    """Numbers strings as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _spread(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each k the places begin[k], begin[k] + 1, ... (counts[k] of them), end to end."""
    ends = np.cumsum(counts)
    return np.repeat(begin - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def encoder(ranks, pattern: str):
    """texts -> an array of ids for each text. `ranks` is a Spark broadcast of the rank table."""
    state: dict = {}

    def encode(texts: list[str]) -> list[np.ndarray]:
        if not state:
            state.update(replay=Replay(ranks.value), split=regex.compile(pattern), number=Numbering(), ids=np.zeros(0, np.int32), start=np.zeros(1, np.int64))
            trim()
        if len(state["number"]) > REMEMBERED:
            state.update(number=Numbering(), ids=np.zeros(0, np.int32), start=np.zeros(1, np.int64))
        number, split = state["number"], state["split"]
        known = len(number)
        pieces = []
        for text in texts:
            found = split.findall(text)
            pieces.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        if len(number) > known:
            new = [s.encode("utf-8", "replace") for s in list(number)[known:]]
            ids, start = state["replay"].encode(new)
            state["start"] = np.concatenate((state["start"], start[1:] + state["start"][-1]))
            state["ids"] = np.concatenate((state["ids"], ids))
        ids, start = state["ids"], state["start"]
        return [ids[_spread(start[p + 1] - start[p], start[p])] for p in pieces]

    return encode, state


_OUTPUTS = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("binary", pa.binary()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_documents(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = tuple(_OUTPUTS)) -> DataFrame:
    """The columns `keep`, then of every whole text those of n_tokens, ids, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded (the bytes that the ids stand for) and decoded_sha256 that `outputs` names.

    A null text counts as empty and has no ids. Columns of df other than `keep` and the text are not read, so clashing
    names do no harm. Repeated rows are encoded alike. No shuffle: a task's memory is bounded by one Arrow batch, one
    text and REMEMBERED pieces. The rank table (of fixed size) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, state = encoder(shared, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "").to_pylist()
            for lo, hi in _parts(texts):
                out = encode(texts[lo:hi])
                made: dict[str, pa.Array] = {}
                if "n_tokens" in outputs:
                    made["n_tokens"] = pa.array([len(i) for i in out], pa.int64())
                if "ids" in outputs:
                    offsets = np.concatenate(([0], np.cumsum([len(i) for i in out]))).astype(np.int32)
                    made["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out), pa.int32()))
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in out])
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    decoded = list(map(state["replay"].decode, out))
                    made["decoded"] = pa.array(decoded, pa.binary())
                    made["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in decoded])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), *(made[n] for n in outputs)], names=[*names, *outputs])

    names = [f"k{k}" for k in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").cast("string").alias("__text"))
    ddl = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema.fields, strict=False)]
    made = arrow_map(rows, run, ", ".join([*ddl, *(f"{n} {_OUTPUTS[n][0]}" for n in outputs)]))
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *outputs)


def _parts(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters, a longer one alone."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield lo, k
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of its ids; null ids decode to null, ids outside the vocabulary raise."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    shared = df.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("binary")
    def decode(column: pd.Series) -> pd.Series:
        table = shared.value
        return pd.Series([None if row is None else b"".join([table[int(i)] for i in row]) for row in column], dtype=object)

    return df.withColumn(out, decode(F.col(f"`{ids}`")))
