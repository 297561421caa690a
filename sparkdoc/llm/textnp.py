"""Words and sentences of many texts at once: numpy over the bytes of an Arrow batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..n and its inverses modulo 2^64."""
    if len(_tables.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each run of bytes that are not `space`; runs end with their text."""
    inside = ~space[raw]
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # an empty last text marks n
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    start = np.flatnonzero(opens)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:n]
    end = np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hash_runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a polynomial modulo 2^64 from one running sum, scrambled with the length."""
    from .util import mix64

    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
        plain = (sums[end] - sums[start]) * down[start]
        return mix64(plain ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def digest_runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit BLAKE2 digest of each run of bytes; each distinct run is digested once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[start] += 1
    np.subtract.at(edge, end, 1)
    data = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    bounds = np.concatenate(([0], np.cumsum(end - start)))
    runs = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    known = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in runs.dictionary.to_pylist()), np.uint64)
    return known[runs.indices.to_numpy()]
