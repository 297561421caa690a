"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a session whose executors live in the driver's own process (master local) gets a temporary folder;
    on a cluster that folder would be lost on other machines, so there the setting has to be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkdoc-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like `names` that none of the taken ones clashes with, whatever its case."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        made = f"__{name}"
        while made.lower() in known:
            made += "_"
        known.add(made.lower())
        out.append(made)
    return out


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, lost executors cost nothing.

    The files go when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path) if partition_by else spark.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder is the cluster's to clean
        pass


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds, as a binary column."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


#: Bytes of one Arrow batch, about: two workers and the JVM's buffers share an executor's memory.
BATCH = 16 << 20


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with small batches, whose memory goes back to the system as the work goes on.

    Lowers the session's spark.sql.execution.arrow.maxBytesPerBatch to BATCH if it is higher.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", str(conf.get(key)))
    if now is None or not 0 < int(now[0]) <= BATCH:
        conf.set(key, str(BATCH))

    def tidy(batches):
        try:
            for k, out in enumerate(run(batches)):
                yield out
                if k % 16 == 15:
                    trim()
        finally:
            trim()

    return df.mapInArrow(tidy, schema)


def trim() -> None:
    """Give freed memory back: workers live on between tasks and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def long_of(column: pa.Array) -> np.ndarray:
    """An integer column without nulls as int64."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def chunks(offsets: np.ndarray, most: int):
    """Runs (from, to) of rows that hold about `most` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def label_components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) for each node, root being its smallest node.

    Alternates large-star and small-star rounds, each a pair of shuffles over the links, until nothing moves. Each
    round is written to the shared folder, so lost executors never replay earlier rounds.
    """
    both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = cut(both), None
    while True:
        mirrored = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mirrored.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = mirrored.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        edges = cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def gather(df: DataFrame, size: int, dtype: str, add, combine: str = "add", pieces: int = 64) -> np.ndarray:
    """One array of `size` numbers (a fixed bound, whatever the input) summed ("add") or united ("or") over all rows.

    add(array, batch) enters an Arrow batch into a task's own array. Tasks send compressed pieces, each piece is combined
    in one place, and the driver gets the finished array.
    """
    import zlib
    from collections.abc import Iterator

    step = -(-size // pieces)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            mine = np.zeros(size, dtype) if mine is None else mine
            add(mine, batch)
        if mine is not None:
            yield from packed(enumerate(mine[k * step : (k + 1) * step] for k in range(pieces)))

    def packed(parts) -> Iterator[pa.RecordBatch]:
        for k, part in parts:
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["k", "b"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(b), dtype)
                if k not in held:
                    held[k] = part.copy()
                elif combine == "add":
                    held[k] += part
                else:
                    held[k] |= part
        yield from packed(sorted(held.items()))

    out = np.zeros(size, dtype)
    for r in arrow_map(arrow_map(df, partial, "k int, b binary").repartition("k"), united, "k int, b binary").collect():
        part = np.frombuffer(zlib.decompress(r["b"]), dtype)
        out[r["k"] * step : r["k"] * step + len(part)] = part
    return out


#: Bits of the largest filter, as a power of two (16 MB), and the least bits a key that make a filter worth while.
MOST_BITS, BITS_A_KEY = 27, 8


class Bits:
    """A Bloom filter of bounded size over 64-bit keys: `holds` may say yes too often, never no wrongly."""

    @staticmethod
    def fits(expected: int) -> bool:
        """Whether the largest filter still tells so many keys from others; beyond that callers join instead."""
        return expected * BITS_A_KEY <= 1 << MOST_BITS

    def __init__(self, expected: int, probes: int = 2):
        self.bits = min(MOST_BITS, max(13, int(max(expected, 1) * 12).bit_length()))
        self.probes, self.array = probes, np.zeros(1 << (self.bits - 3), np.uint8)

    def _at(self, keys: np.ndarray) -> list[np.ndarray]:
        keys = keys.astype(np.int64).view(np.uint64)
        seeds = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(self.probes)]
        return [mix64(keys ^ seed) >> np.uint64(64 - self.bits) for seed in seeds]

    def enter(self, array: np.ndarray, keys: np.ndarray) -> None:
        for at in self._at(keys):
            np.bitwise_or.at(array, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        yes = np.ones(len(keys), bool)
        for at in self._at(keys):
            yes &= (self.array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return yes

    def fill(self, keys: DataFrame) -> Bits:
        """Enter a one-column table of keys (distributed; the driver gets the bounded array only)."""
        empty = Bits.__new__(Bits)
        empty.bits, empty.probes, empty.array = self.bits, self.probes, np.zeros(0, np.uint8)
        self.array = gather(keys, len(self.array), "uint8", lambda array, batch: empty.enter(array, long_of(batch.column(0))), "or")
        return self


class Sieve:
    """Rows of a table whose `key` may be in a one-column table of keys.

    While the keys fit a filter of bounded size, `rows` is the whole table and `holds` has to be asked for each row; beyond
    that `rows` is a semi-join and everything holds. Either way the cost is linear in the table.
    """

    def __init__(self, rows: DataFrame, keys: DataFrame, key: str = "doc_id", count: int | None = None):
        name = keys.columns[0]
        known = keys.select(F.col(f"`{name}`").cast("long").alias(key)).where(F.col(key).isNotNull())
        n = known.count() if count is None else count
        if Bits.fits(n):
            self.rows, self.shared = rows, rows.sparkSession.sparkContext.broadcast(Bits(n).fill(known))
        else:
            self.rows, self.shared = rows.join(known.distinct(), key, "left_semi"), None

    def test(self):
        """A function of an array of keys, for tasks: which of them pass."""
        shared = self.shared
        return (lambda keys: np.ones(len(keys), bool)) if shared is None else (lambda keys: shared.value.holds(keys))


def sift(df: DataFrame, ids: DataFrame, id_column: str = "doc_id", inside: bool = True) -> DataFrame:
    """Rows of df whose id is (inside) or is not in the one-column table ids; null ids never are.

    A Bloom filter of bounded size decides for most rows without a shuffle; only rows that it takes for members meet the
    table itself. More ids than such a filter holds are joined with all rows. Columns of df keep their names.
    """
    name = ids.columns[0]
    flag, own = fresh(df.columns, "maybe", "id")
    key = F.col(f"`{id_column}`").cast("long")
    members = ids.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").cast("long").alias(own)).distinct()
    n = ids.count()
    if not Bits.fits(n):
        return df.join(members, key == F.col(own), "left_semi" if inside else "left_anti")
    shared = df.sparkSession.sparkContext.broadcast(Bits(n).fill(members))

    @F.pandas_udf("boolean")
    def maybe(column):
        import pandas as pd

        return pd.Series(shared.value.holds(column.fillna(0).to_numpy(np.int64)) & column.notna().to_numpy())

    flagged = df.withColumn(flag, maybe(key))
    met = flagged.where(F.col(flag)).join(members, key == F.col(own), "left_semi" if inside else "left_anti").drop(flag)
    return met if inside else flagged.where(~F.col(flag)).drop(flag).unionByName(met)
