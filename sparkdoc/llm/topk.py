"""Exact top-k search by pivot-table elimination.

Vectors are integers after scaling. For Euclidean distance d, q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2, so a lower bound on
the distance is an upper bound on the score. A stored table holds every vector's distances to many pivots; by the
triangle inequality max over pivots of |d(q,p) - d(x,p)| bounds d(q,x) from below.

* The table is computed once and written to the shared folder. Vectors lie in cells by their nearest pivot, cells are cut
  into blocks.
* Each query first meets one block of its own cell. The k-th score there is its floor from then on, in every block.
* Where a cell's ranges of distances show that nothing in it reaches the floor, the query does not go to that cell.
* In a block, candidates are evaluated exactly in the order of their bounds, and a query stops when its k-th score (or
  its floor) is above every bound that is left.
* A probe of a few queries decides for a group of queries and a block whether the bounds leave more than a quarter of the
  candidates, as on vectors that are hardly clustered. Then one matrix product serves the group.

The pivots come from a bounded sample; the table holds every row, so the result is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import arrow_map, cut

#: Rows of one block of candidates and of one block of queries; rows from which pivots are picked, and how many.
CANDIDATES, QUERIES, PIVOT_SAMPLE, PIVOTS = 8192, 1024, 2048, 32
#: The cell of vectors whose scores may be no exact doubles: they are compared in whole numbers, without bounds.
WIDE = -1
#: Scores outside of a long are given as its ends.
LEAST, MOST = -(2**63), 2**63 - 1


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return embedding.isNotNull() & ~F.exists(embedding, odd)


def scaled(embedding: Column, scale: float) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def narrow_limit(d: int) -> int:
    """Components up to this have inner products, and sums of squares, that doubles hold exactly."""
    return min(2**31 - 1, int((2**51 / max(d, 1)) ** 0.5))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal: every next pivot is the row farthest from those before."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, those outside of a long as its ends."""
    most = [max(-int(a.min(initial=0)), int(a.max(initial=0))) for a in (query, rows)]
    if query.shape[1] * most[0] * most[1] < 2**63:
        return query.astype(np.int64) @ rows.astype(np.int64).T
    return np.clip(query.astype(object) @ rows.astype(object).T, LEAST, MOST).astype(np.int64)


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller name."""
    if len(scores) > k:
        fair = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, names = scores[fair], names[fair]
    top = np.lexsort((-names, scores))[::-1][:k]
    return scores[top], names[top]


class Block:
    """Candidates of one block: ids, vectors, their rows of the pivot table."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, table: np.ndarray, pivot_norm: float):
        self.ids, self.rows = ids, rows
        self.to_pivot = np.ascontiguousarray(table.T)
        self.square = (rows**2).sum(1)
        self.largest = self.square.max(initial=0) + pivot_norm
        self.evaluated = 0

    def bounds(self, to_pivot: np.ndarray, square: float) -> np.ndarray:
        """Upper bounds on the scores with a query: rounding may make them too high, never too low."""
        low, gap = np.zeros(len(self.ids), np.float32), np.empty(len(self.ids), np.float32)
        for mine, its in zip(self.to_pivot, to_pivot, strict=True):
            np.subtract(mine, its, out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        low = low.astype(np.float64)
        return (self.square - low * low + square) / 2 + 4e-6 * (self.largest + square) + 1e-3

    def ordered(self, query: np.ndarray, query_id: int, bound: np.ndarray, floor: float, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best by evaluation in bound order, in portions that double, until no bound reaches the k-th score."""
        left = np.flatnonzero((bound >= floor) & (self.ids != query_id))
        best, portion = (np.zeros(0), np.zeros(0, np.int64)), max(first, 2 * k)
        while len(left):
            if len(left) > portion:
                by = np.argpartition(-bound[left], portion)
                take, left = left[by[:portion]], left[by[portion:]]
            else:
                take, left = left, left[:0]
            self.evaluated += len(take)
            scores = self.rows[take] @ query
            best = _best(np.concatenate((best[0], scores)), np.concatenate((best[1], self.ids[take])), k)
            if len(best[0]) == k:
                left = left[bound[left] >= best[0][-1]]
            portion *= 2
        fair = best[0] >= floor
        return best[0][fair], best[1][fair]

    def search(self, query: np.ndarray, query_id: np.ndarray, table: np.ndarray, floor: np.ndarray, k: int, first: int = 128, together: int = 128, probe: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of query, vec_id, score) of every query's best in the block that reach its floor, k at most."""
        square, out = (query**2).sum(1), []
        for at in range(0, len(query), together):
            group = range(at, min(at + together, len(query)))
            bounds = {i: self.bounds(table[i], square[i]) for i in group[:probe]}
            left = sum(int(np.count_nonzero(b >= floor[i])) for i, b in bounds.items())
            if left * 4 > len(self.ids) * len(bounds):
                dense = query[group.start : group.stop] @ self.rows.T
                self.evaluated += dense.size
                for i in group:
                    fair = np.flatnonzero((dense[i - at] >= floor[i]) & (self.ids != query_id[i]))
                    out.append((i, *_best(dense[i - at, fair], self.ids[fair], k)))
            else:
                for i in group:
                    bound = bounds[i] if i in bounds else self.bounds(table[i], square[i])
                    out.append((i, *self.ordered(query[i], query_id[i], bound, floor[i], k, first)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.repeat([o[0] for o in out], [len(o[1]) for o in out]), np.concatenate([o[2] for o in out]), np.concatenate([o[1] for o in out])


def search_wide(query: np.ndarray, query_id: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, together: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in whole numbers of any size, without bounds or floors."""
    index, names, scores = [], [], []
    for at in range(0, len(query), together):
        found = exact_scores(query[at : at + together], rows)
        for i in range(len(found)):
            other = np.flatnonzero(ids != query_id[at + i])
            s, n = _best(found[i, other], ids[other], k)
            index.append(np.full(len(n), at + i))
            names.append(n)
            scores.append(s)
    return np.concatenate(index), np.concatenate(names), np.concatenate(scores)


def _by(*keys: np.ndarray) -> list[np.ndarray]:
    """Places grouped by equal keys."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(max(len(order) - 1, 0), bool)
    for key in keys:
        change |= np.diff(key[order]) != 0
    return np.split(order, np.flatnonzero(change) + 1) if len(order) else []


def _table(rows: DataFrame, pivots, cells: dict[int, int]) -> DataFrame:
    """id, q, d, cell, v, t: vectors as bytes (32-bit, wide ones 64-bit) with their distances to all pivots (float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets)).astype(np.int64)
            flat, ids, asked = batch.column(1).flatten().to_numpy(), batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for group in _by(sizes):
                d = int(sizes[group[0]])
                matrix = flat[(starts[group][:, None] + np.arange(d)[None]).ravel()].astype(np.int64).reshape(len(group), d)
                wide = ((matrix > narrow_limit(d)) | (matrix < -narrow_limit(d))).any(1)
                own = pivots.value.get(d, np.zeros((0, d)))
                table = distances(np.where(wide[:, None], 0, matrix).astype(np.float64), own)
                cell = np.where(wide, WIDE, table[:, : cells.get(d, 1)].argmin(1) if table.shape[1] else 0)
                near, far = matrix.astype(np.int32), table.astype(np.float32)
                vectors = [matrix[i].tobytes() if wide[i] else near[i].tobytes() for i in range(len(group))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[group]), pa.array(asked[group]), pa.array(np.full(len(group), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(vectors, pa.binary()), pa.array([t.tobytes() for t in far], pa.binary())], names=["id", "q", "d", "cell", "v", "t"])

    return cut(arrow_map(rows, run, "id long, q boolean, d int, cell int, v binary, t binary"))


def _ranges(table: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]:
    """For each cell (a number that does not grow with the rows): least and greatest distance to each pivot, greatest |x|^2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            d, cell = batch.column("d").to_numpy(), batch.column("cell").to_numpy()
            if "lo" in batch.schema.names:
                made = [((int(d[i]), int(cell[i])), *(np.frombuffer(batch.column(c)[i].as_py(), np.float32) for c in ("lo", "hi")), float(batch.column("most")[i].as_py())) for i in range(batch.num_rows)]
            else:
                made = []
                for group in _by(d, cell):
                    t = np.frombuffer(b"".join(batch.column("t").take(pa.array(group)).to_pylist()), np.float32).reshape(len(group), -1)
                    v = np.frombuffer(b"".join(batch.column("v").take(pa.array(group)).to_pylist()), np.int64 if cell[group[0]] == WIDE else np.int32)
                    square = (v.reshape(len(group), -1).astype(np.float64) ** 2).sum(1).max(initial=0)
                    made.append(((int(d[group[0]]), int(cell[group[0]])), t.min(0), t.max(0), float(square)))
            for name, lo, hi, most in made:
                old = held.get(name)
                held[name] = (lo, hi, most) if old is None else (np.minimum(old[0], lo), np.maximum(old[1], hi), max(old[2], most))
        if held:
            names = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.int32()), pa.array([n[1] for n in names], pa.int32()), *(pa.array([held[n][k].tobytes() for n in names], pa.binary()) for k in (0, 1)), pa.array([held[n][2] for n in names], pa.float64())], names=["d", "cell", "lo", "hi", "most"])

    schema = "d int, cell int, lo binary, hi binary, most double"
    rows = arrow_map(arrow_map(table.select("d", "cell", "v", "t"), run, schema).repartition("d", "cell"), run, schema).collect()
    return {(r["d"], r["cell"]): (np.frombuffer(r["lo"], np.float32), np.frombuffer(r["hi"], np.float32), r["most"]) for r in rows}


def top_k(df: DataFrame, k: int = 20, query: Column | None = None, id_column: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over all other rows.

    Ties go to the smaller vec_id; fewer than k other rows give fewer results. `query` marks the query rows (default:
    all). Unusable vectors (see `usable`) and null ids take no part; vectors of different lengths are never compared.
    Rows that repeat an id are candidates each on their own, no row is a candidate for a query of its own id, and query
    rows that repeat an id share one ranking. An empty table gives no rows. Other columns are not read, whatever their
    names. Components of any size are compared exactly; those beyond a long stand at its ends, and so do scores, which then tie.

    The stated query set meets all rows in blocks: blocks hold about CANDIDATES rows, and packed blocks of queries go to
    each that their floors do not rule out. A pair of blocks is one unit of work, whatever its vectors look like; its
    memory is bounded by the two constants. The driver holds pivots and one range a cell.
    """
    spark = df.sparkSession
    vec, vid = F.col(f"`{embedding}`"), F.col(f"`{id_column}`").cast("long")
    is_query = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    rows = df.where(usable(vec) & vid.isNotNull()).select(vid.alias("id"), scaled(vec, scale).alias("v"), is_query.alias("q"))
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()]
    of_size = {d: [v for v in sample if len(v) == d and all(abs(x) <= narrow_limit(d) for x in v)] for d in sizes}
    pivots = {d: pick_pivots(np.array(own, np.float64).reshape(len(own), d), PIVOTS) for d, own in of_size.items()}
    shared = spark.sparkContext.broadcast(pivots)
    table = _table(rows, shared, {d: max(1, min(PIVOTS, n // CANDIDATES)) for d, n in sizes.items()})
    ranges = spark.sparkContext.broadcast(_ranges(table))
    blocks = {(r["d"], r["cell"]): max(1, -(-r["n"] // CANDIDATES)) for r in table.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_cell = F.create_map(*[F.lit(x) for (d, c), n in blocks.items() for x in (f"{d} {c}", n)])
    n_blocks = F.element_at(of_cell, F.concat_ws(" ", "d", "cell"))
    place = F.pmod(F.xxhash64(F.lit(7), "id", "v"), n_blocks).cast("int")
    none = F.lit(None).cast("double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block (d, home cell, cell, block, side), each batch's share packed into one row."""
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in _KEYS]
            ids, floors = batch.column("id").to_numpy(), np.nan_to_num(batch.column("floor").to_numpy(zero_copy_only=False), nan=-np.inf)
            for group in _by(*keys):
                at = pa.array(group)
                joined = [b"".join(batch.column(c).take(at).to_pylist()) for c in ("v", "t")]
                yield _packed([int(key[group[0]]) for key in keys], ids[group], *joined, floors[group])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of packed queries for every cell where one of them may find something that reaches its floor."""
        for batch in batches:
            for d, home, _, _, side, ids, v, t, floors in zip(*(batch.column(c).to_pylist() for c in _PACKED), strict=True):
                ids, floors = np.frombuffer(ids, np.int64), np.frombuffer(floors, np.float64)
                vectors = np.frombuffer(v, np.int64 if home == WIDE else np.int32).reshape(len(ids), -1)
                distance, square = np.frombuffer(t, np.float32).reshape(len(ids), -1), (vectors.astype(np.float64) ** 2).sum(1)
                norm = (shared.value[d] ** 2).sum(1).max(initial=0)
                for (of, cell), (lo, hi, most) in ranges.value.items():
                    if of != d:
                        continue
                    go = np.ones(len(ids), bool)
                    if WIDE not in (home, cell):
                        gap = np.maximum(np.maximum(lo - distance, distance - hi), 0).max(1, initial=0).astype(np.float64)
                        go = (square + most - gap**2) / 2 + 4e-6 * (square + most + norm) + 1e-3 >= floors
                    if go.any():
                        yield _packed([d, home, cell, 0, side], ids[go], vectors[go].tobytes(), distance[go].tobytes(), floors[go])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in order, each with its candidates before its queries."""
        at, parts, block = None, [], None
        for batch in batches:
            for d, home, cell, number, side, ids, v, t, floors in zip(*(batch.column(c).to_pylist() for c in _PACKED), strict=True):
                if (d, cell, number) != at:
                    at, parts, block = (d, cell, number), [], None
                ids = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(v, np.int64 if (home if side else cell) == WIDE else np.int32).reshape(len(ids), -1)
                distance = np.frombuffer(t, np.float32).reshape(len(ids), -1)
                if side == 0:
                    parts.append((ids, vectors, distance))
                    continue
                if not parts:
                    continue
                if block is None:
                    held = [np.concatenate(p) for p in zip(*parts, strict=True)]
                    block = Block(held[0], held[1].astype(np.float64), held[2], (shared.value[d] ** 2).sum(1).max(initial=0)) if cell != WIDE else None
                for lo in range(0, len(ids), QUERIES):
                    own, names = vectors[lo : lo + QUERIES], ids[lo : lo + QUERIES]
                    if WIDE in (home, cell):
                        q, i, s = search_wide(own.astype(np.int64), names, held[1].astype(np.int64), held[0], k)
                    else:
                        q, i, s = block.search(own.astype(np.float64), names, distance[lo : lo + QUERIES], np.frombuffer(floors, np.float64)[lo : lo + QUERIES], k)
                        s = s.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    schema = "d int, home int, cell int, block int, side int, ids binary, v binary, t binary, floors binary"
    found = "query_id long, vec_id long, score long"
    in_block = table.select("d", F.lit(0).alias("home"), "cell", place.alias("block"), F.lit(0).alias("side"), "id", "v", "t", none.alias("floor"))
    candidates = arrow_map(in_block, pack, schema)
    asked = table.where("q")

    def meet(units: int, queries: DataFrame, among: DataFrame) -> DataFrame:
        met = among.unionByName(queries).repartition(max(units, 1), "d", "cell", "block").sortWithinPartitions("d", "cell", "block", "side")
        return arrow_map(met, search, found)

    # 1: floors, from one block of the query's own cell
    at_home = arrow_map(asked.where(F.col("cell") != WIDE).select("d", F.lit(0).alias("home"), "cell", F.lit(0).alias("block"), F.lit(1).alias("side"), "id", "v", "t", none.alias("floor")), pack, schema)
    tried = meet(len(blocks), at_home, arrow_map(in_block.where("block = 0"), pack, schema))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = tried.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    repeated = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    floors = cut(kth.join(repeated, "id", "left_anti"))  # query rows that share an id have none
    # 2: all blocks that the floors do not rule out; queries of a block come together once, then packed copies go out
    group = F.pmod(F.xxhash64(F.lit(8), "id", "v"), F.ceil(n_blocks * CANDIDATES / QUERIES)).cast("int")
    with_floor = asked.join(floors, "id", "left").select("d", F.col("cell").alias("home"), F.lit(0).alias("cell"), group.alias("block"), F.lit(1).alias("side"), "id", "v", "t", "floor")
    queries = arrow_map(arrow_map(with_floor.repartition("d", "home", "block"), pack, schema), aim, schema)
    copies = queries.select(*[c if c != "block" else F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block") for c in _PACKED])
    answers = meet(sum(blocks.values()), copies, candidates)
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_KEYS = ["d", "home", "cell", "block", "side"]
_PACKED = [*_KEYS, "ids", "v", "t", "floors"]


def _packed(keys: list[int], ids: np.ndarray, v: bytes, t: bytes, floors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in keys), *(pa.array([x], pa.binary()) for x in (ids.astype(np.int64).tobytes(), v, t, floors.astype(np.float64).tobytes()))], names=_PACKED)
