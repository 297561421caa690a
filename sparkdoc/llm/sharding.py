"""Sharding: a uniform shuffle into shards of exact sizes.

A hypergeometric communication matrix says how many rows each source partition sends to each shard. Every partition
permutes its rows and deals them out by its row of the matrix, the rows are exchanged, and every shard permutes what it
got. SQL functions only: permutations are orders by seeded hashes, ranks come from windows over bounded ranges of them.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hypergeometric import communication_matrix
from .util import cut

#: Rows of one source partition and of one range of a shard, about; the most of either.
ROWS_PER_PART, MOST_PARTS = 1000, 8192


def _power(rows: int, most: int) -> int:
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_PART)))))


def _numbered(rows: DataFrame, identity: list[str]) -> DataFrame:
    """rows with `number`: 0, 1, ... for rows alike in all identity columns, 0 where there is but one.

    Copies are numbered within the partitions that they lie in, behind running counts over partitions, so no task gets all
    copies of a row. The set of numbers does not depend on partitions.
    """
    columns = [F.col(c) for c in identity]
    repeated = cut(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    if not repeated.limit(1).count():
        return rows.withColumn("number", F.lit(0).cast("long"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in identity])
    rows = rows.withColumn("lies", F.spark_partition_id())
    tagged = rows.join(repeated, same(rows, repeated), "left").select(*[rows[c] for c in rows.columns], "copies")
    many = cut(tagged.where("copies > 1").drop("copies"))  # their partitions stay as they are written
    counts = many.groupBy(*columns, "lies").agg(F.count(F.lit(1)).alias("n"))
    before = cut(counts.withColumn("before", F.sum("n").over(Window.partitionBy(*columns).orderBy("lies").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n"))
    within = many.withColumn("within", F.row_number().over(Window.partitionBy(*columns, "lies").orderBy(F.lit(0))) - 1)
    placed = within.join(before, same(within, before) & (within["lies"] == before["lies"])).select(*[within[c] for c in rows.columns if c != "lies"], (F.col("before") + F.col("within")).cast("long").alias("number"))
    return tagged.where("copies is null").drop("copies", "lies").withColumn("number", F.lit(0).cast("long")).unionByName(placed)


def shard_rows(df: DataFrame, shards: int, identity: list[str], seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with `shard` (0 to shards - 1; counts differ by one at most) and `slot` (gapless from 0 in its shard).

    Every assignment of rows to slots is equally likely under the seed's hashes. `identity` names the columns whose
    hash tells rows apart; rows alike in all of them are interchangeable: they are numbered, and a rerun deals such rows to the
    same slots. Null identities hash like any value; texts of any length only travel along; an empty table stays empty.
    Columns of df named like the two new ones are replaced; others keep their names, whatever they are. The driver holds the
    counts of at most MOST_PARTS partitions and shards x ranges.
    """
    keep = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    safe = {c: f"c{i}" for i, c in enumerate(df.columns)}
    columns = [F.col(safe[c]) for c in identity] + [F.col("number")]
    base = df.select(*[F.col(f"`{c}`").alias(n) for c, n in safe.items()])
    rows = df.count()
    if not rows:
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias(shard), F.lit(None).cast("long").alias(slot)).where("false")
    base = _numbered(base, [safe[c] for c in identity])
    hashed: Column = F.xxhash64(F.lit(seed), *columns)
    parts = _power(rows, MOST_PARTS)
    # 1: source partitions are slices of a hash, so a retried task finds the same rows again
    part = F.pmod(hashed, F.lit(parts)).cast("int")
    counts = dict(base.groupBy(part.alias("p")).count().collect())
    sizes = [counts.get(p, 0) for p in range(parts)]
    targets = [rows // shards + (s < rows % shards) for s in range(shards)]
    matrix = communication_matrix(np.random.default_rng(seed), sizes, targets)
    spark = df.sparkSession
    deal = spark.createDataFrame([(p, np.cumsum(matrix[p]).tolist()) for p in range(parts)], "part int, ends array<bigint>")
    # 2: permute within the partition and deal out by the matrix
    once, twice = F.xxhash64(F.lit(seed + 1), *columns), F.xxhash64(F.lit(seed + 2), *columns)
    local = Window.partitionBy("part").orderBy("once", *columns)
    rank = base.withColumns({"part": part, "once": once, "twice": twice}).withColumn("rank", F.row_number().over(local) - 1)
    dealt = rank.join(F.broadcast(deal), "part").withColumn("to", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    # 3: exchange; 4: permute again: ranges of the second hash are ranked on their own, their starts are running sums
    bits = int(math.log2(_power(rows // shards + 1, MOST_PARTS)))
    zone = (F.shiftrightunsigned("twice", 64 - bits) if bits else F.lit(0)).cast("int")
    zoned = dealt.withColumn("zone", zone)
    starts = zoned.groupBy("to", "zone").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.sum("n").over(Window.partitionBy("to").orderBy("zone").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    starts = spark.createDataFrame(starts.select("to", "zone", "start").collect(), "to int, zone int, start bigint")
    again = Window.partitionBy("to", "zone").orderBy(F.col("twice"), F.col("once"), *columns)
    placed = zoned.withColumn("at", F.row_number().over(again)).join(F.broadcast(starts), ["to", "zone"])
    return placed.select(*[F.col(safe[c]).alias(c) for c in keep], F.col("to").cast("int").alias(shard), (F.col("start") + F.col("at") - 1).cast("long").alias(slot))
