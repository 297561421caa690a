"""License scans by patience alignment.

A stretch of a document is aligned with a template on the words that occur exactly once in both; the longest increasing
subsequence of those anchors is kept, and every gap between anchors is aligned in the same way, after equal words at
its ends are matched. The share of the template's words that are matched in order is its coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import LINES, SPDX_LINES, TEXTS
from .util import arrow_map

TEMPLATES = {**TEXTS, **LINES, **SPDX_LINES}

#: Least share of a template that counts as found; least share of its length that a stretch must hold of its words.
COVERAGE, DENSITY = 0.8, 0.6
#: Templates of more words than this are tried from every eighth of their length on, shorter ones from every word.
LONG = 400

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        if at:
            back[k] = ends[at - 1]
        if at == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[at], ends[at] = v, k
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places (in text, in template), increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: k for k, w in enumerate(text[a:b], a) if in_text[w] == 1}
        pairs = [(where[w], k) for k, w in enumerate(template[c:d], c) if in_template[w] == 1 and w in where]
        anchors = [pairs[k] for k in increasing([p for p, _ in pairs])]
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if r > p + 1 and s > q + 1]
    return sorted(found)


class Scanner:
    """`whole`: names of templates of which every word has to be there, in order and with nothing between."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, density: float = DENSITY, whole: frozenset[str] = frozenset(SPDX_LINES)):
        self.coverage, self.density, self.whole = coverage, density, whole
        self.names = list(templates)
        self.texts = [words_of(t) for t in templates.values()]
        vocabulary = sorted({w for t in self.texts for w in t})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.coded = [[self.number[w] for w in t] for t in self.texts]
        self.member = np.zeros((len(self.texts), len(vocabulary) + 1), bool)
        self.spare = np.zeros((len(self.texts), len(vocabulary)), np.int32)  # how often a template has each word
        for k, t in enumerate(self.coded):
            self.member[k, t] = True
            self.spare[k] = np.bincount(t, minlength=len(vocabulary))
        self.need = np.array([self.least(k) for k in range(len(self.coded))])

    def least(self, k: int) -> int:
        """Words of template k that have to be matched."""
        n = len(self.coded[k])
        return n if self.names[k] in self.whole else max(1, int(np.ceil(self.coverage * n - 1e-9)))

    def stretches(self, hit: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """Stretches of the document that windows dense in the template's words cover, with room at both ends; windows
        that overlap, or whose room does, are one stretch."""
        need = max(1, int(np.ceil(self.density * length)))
        n = len(hit)
        total = np.concatenate(([0], np.cumsum(hit)))
        if total[-1] < need:
            return
        begin = np.flatnonzero(hit)
        dense = begin[total[np.minimum(begin + length, n)] - total[begin] >= need]
        if not len(dense):
            return
        room = length // 4
        breaks = np.flatnonzero(np.diff(dense) > length + 2 * room)
        for first, last in zip(dense[np.concatenate(([0], breaks + 1))].tolist(), dense[np.concatenate((breaks, [len(dense) - 1]))].tolist(), strict=True):
            yield max(0, first - room), min(n, last + length + room)

    def copies(self, text: list[int], template: list[int], need: int) -> Iterator[list[tuple[int, int]]]:
        """Alignments of the template that reach the coverage, disjoint: the best of all places first, then what is left
        on either side of it.

        Every word is tried as the start of a short and a long window; of templates beyond LONG words every eighth of their
        length, which puts a copy of up to 11/8 of it wholly into some window. A window's words counted against the template's
        bound what any alignment in it can match, so that the search goes down by bounds and stops below the best match.
        """
        length = len(template)
        width, grid = length + 2 * (length // 4), 1 if length <= LONG else length // 8
        todo = [(0, len(text))]
        while todo:
            lo, hi = todo.pop()
            starts = [x for x in self.bounds(text, template, lo, hi, width) if x[0] >= need and (x[1] - lo) % grid == 0]
            starts.sort(key=lambda x: (-x[0], x[1]))
            best: tuple | None = None
            for bound, at in starts:
                if best is not None and (bound < -best[0] or best[:2] == (-length, length)):
                    break
                for end in {min(hi, at + length), min(hi, at + width)}:
                    matched = patience(text[at:end], template)
                    if len(matched) >= need:
                        key = -len(matched), matched[-1][0] - matched[0][0] + 1, at + matched[0][0]
                        if best is None or key < best[:3]:
                            best = (*key, [(at + p, q) for p, q in matched])
            if best is not None:
                yield best[3]
                todo += [(lo, best[3][0][0]), (best[3][-1][0] + 1, hi)]

    @staticmethod
    def bounds(text: list[int], template: list[int], lo: int, hi: int, width: int) -> Iterator[tuple[int, int]]:
        """(words that the window from there has in common with the template, repeats counted, start) for every start."""
        spare = Counter(template)
        known, end, common = set(template), lo, 0
        for at in range(lo, hi):
            while end < min(hi, at + width):
                w = text[end]
                if w in known:
                    common += spare[w] > 0
                    spare[w] -= 1
                end += 1
            yield common, at
            w = text[at]
            if w in known:
                spare[w] += 1
                common -= spare[w] > 0

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first word, end word) of every stretch that holds a template."""
        found = words_of(text)
        codes = np.fromiter((self.number.get(w, -1) for w in found), np.int32, len(found))
        held = np.bincount(codes[codes >= 0], minlength=self.spare.shape[1])
        # a template whose words the text does not even hold, in whatever order, is not in it
        out = []
        for k in np.flatnonzero(np.minimum(self.spare, held).sum(1) >= self.need).tolist():
            template = self.coded[k]
            hit = self.member[k, codes]
            for lo, hi in self.stretches(hit, len(template)):
                for matched in self.copies(codes[lo:hi].tolist(), template, int(self.need[k])):
                    if self.names[k] in self.whole and matched[-1][0] - matched[0][0] >= len(template):
                        continue
                    out.append((self.names[k], len(matched) / len(template), len(matched), lo + matched[0][0], lo + matched[-1][0] + 1))
        # longer matches first; a shorter template inside a stretch already explained is not reported again
        out.sort(key=lambda x: (-x[2], -x[1], x[3], x[0]))
        kept: list[tuple[str, float, int, int, int]] = []
        for x in out:
            if all(x[4] <= y[3] or x[3] >= y[4] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: (x[3], x[0]))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_licenses, license (the longest match's template, null if none), coverage, matched, first_word,
    end_word, and matches: all of them in the order of the text.

    Templates are whole public texts, their notices for source files, one-line notices and SPDX lines (`license_texts`).
    Whole texts are scanned, however long: the time of one grows with its length and with the stretches of it that are dense in
    a template's words. Null and empty texts have no license; a license given twice is found twice; of equally long
    matches the first counts as the license; repeated rows are scanned alike; null ids come back; other columns are not
    read, whatever their names; an empty table gives none. No shuffle; memory is one Arrow batch and one document.
    """
    scanner = Scanner(templates or TEMPLATES)
    shared = df.sparkSession.sparkContext.broadcast(scanner)
    one = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    names = [f.name for f in one]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [shared.value.scan(t or "") for t in part.column(1).to_pylist()]
                best = [max(x, key=lambda y: (y[2], y[1], -y[3])) if x else (None,) * 5 for x in found]
                columns = [pa.array([b[k] for b in best], f.type) for k, f in enumerate(one)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), *columns, pa.array([[dict(zip(names, y, strict=True)) for y in x] for x in found], pa.list_(one))], names=["doc_id", "n_licenses", *names, "matches"])

    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = "license:string,coverage:double,matched:long,first_word:long,end_word:long"
    return arrow_map(rows, run, f"doc_id long, n_licenses long, {fields.replace(':', ' ')}, matches array<struct<{fields}>>")
