"""Exact hypergeometric draws on the driver, for populations of any size. The draws are the randomness of the sharding
and mixing operators; they see counts only, never rows."""

from __future__ import annotations

import math

import numpy as np

#: Above this the library's generator refuses; draws then come by inversion around the mode.
LIBRARY_LIMIT = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls taken without replacement from good + bad are good."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    if good < LIBRARY_LIMIT and bad < LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mode = min(max(int((draws + 1) * (good + 1) / (total + 2)), low), high)
    spread = int(12 * math.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 1) / total)) + 64
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    p = np.exp(log_p - log_p.max())
    c = np.cumsum(p)
    return int(k[min(int(np.searchsorted(c, rng.random() * c[-1])), len(k) - 1)])


def multivariate(rng: np.random.Generator, colours: list[int], draws: int) -> list[int]:
    """Counts by colour of `draws` balls taken without replacement."""
    out, rest = [], sum(colours)
    for have in colours:
        rest -= have
        got = hypergeometric(rng, have, rest, draws) if draws else 0
        out.append(got)
        draws -= got
    return out


def communication_matrix(rng: np.random.Generator, sources: list[int], targets: list[int]) -> list[list[int]]:
    """Source-to-target counts of a uniform shuffle; rows sum to sources, columns to targets (whose sums agree).

    The sources are halved recursively; each half takes a multivariate-hypergeometric share of what the targets still lack.
    """
    rows: list[list[int]] = [[] for _ in sources]

    def split(lo: int, hi: int, lacking: list[int]) -> None:
        if hi - lo == 1:
            rows[lo] = lacking
            return
        mid = (lo + hi) // 2
        left = multivariate(rng, lacking, sum(sources[lo:mid]))
        split(lo, mid, left)
        split(mid, hi, [a - b for a, b in zip(lacking, left, strict=True)])

    if sources:
        split(0, len(sources), list(targets))
    return rows
