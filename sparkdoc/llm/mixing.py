"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by a seeded hash and cut into blocks, which are ranges of that hash. A source's
target fixes an exact quota of blocks (the last one cut at the document nearest the target). A tree over the output
shards splits the quotas: at each node the left half's share is drawn from the multivariate hypergeometric law, so all
ways to deal the blocks are equally likely and every block goes to exactly one shard. Shards then order their rows by a
hash of their own. SQL functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hypergeometric import multivariate
from .util import cut

#: Documents that a block holds, about; the most blocks of a source.
DOCS_PER_BLOCK, MOST_BLOCKS = 64, 8192

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words, runs of anything but ASCII white space; null has none."""
    # every word becomes one letter, blanks go: the length is the count, and no array of words is ever made
    letters = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.char_length(letters), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most_epochs: float = 2.0
    shards: int = 8
    seed: int = 0


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """total dealt by weight; no target is above cap times its size, and what is cut off is dealt again by weight."""
    out, open_ = [0.0] * len(sizes), {i for i, (s, w) in enumerate(zip(sizes, weights, strict=True)) if s > 0 and w > 0}
    rest = float(total)
    while open_ and rest > 0:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / whole > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / whole
            break
        for i in sorted(over):
            out[i] = cap * sizes[i]
            rest -= out[i]
        open_ -= over
    return out


def split_quotas(rng: np.random.Generator, quotas: list[int], shards: int) -> list[list[int]]:
    """Blocks of each source that each shard gets: shards' totals differ by one at most, sources' totals are exact."""
    whole = sum(quotas)
    room = [whole // shards + (s < whole % shards) for s in range(shards)]
    out: list[list[int]] = [[] for _ in range(shards)]

    def node(lo: int, hi: int, have: list[int]) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = multivariate(rng, have, sum(room[lo:mid]))
        node(lo, mid, left)
        node(mid, hi, [a - b for a, b in zip(have, left, strict=True)])

    node(0, shards, quotas)
    return out


def sized(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """keep, __size and __source of every document, written once: the texts are read a single time."""
    return cut(docs.select(*[F.col(f"`{c}`") for c in keep], words(F.col(f"`{text}`")).alias("__size"), F.col(f"`{source}`").cast("string").alias("__source")))


def plan_mix(base: DataFrame, identity: list[str], how: Mix = Mix()) -> DataFrame:
    """The plan, one row a source: sizes, targets, and what tells each row of the source how often and where it is drawn.

    base has __size and __source. Null is a source of its own, the last. The driver holds one row a source and at most
    MOST_BLOCKS numbers for each source that is cut inside an epoch. An empty table gives no rows.
    """
    spark = base.sparkSession
    columns = [F.col(f"`{c}`") for c in identity]
    per = base.groupBy("__source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    per.sort(key=lambda r: (r["__source"] is None, (r["__source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in per]
    weights = [how.weights[i % len(how.weights)] for i in range(len(per))]
    aim = targets(sizes, weights, how.share * sum(sizes), how.most_epochs)
    plan = []  # source, blocks, whole epochs, words wanted from the epoch that is cut, size, target
    for r, size, target in zip(per, sizes, aim, strict=True):
        blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, r["docs"] / DOCS_PER_BLOCK)))))
        whole = int(target // size) if size else 0
        plan.append((r["__source"], blocks, whole, target - whole * size if size else 0.0, size, target))
    first = spark.createDataFrame([(p[0], i, *p[1:4]) for i, p in enumerate(plan)], "__source string, __no int, __blocks int, __whole int, __want double")
    tagged = _with_source(base, first).where("__want > 0")
    tagged = tagged.withColumn("__hash", _place(how, F.col("__whole"), columns)).withColumn("__block", _block(F.col("__hash")))
    # the epoch that is cut: words of its blocks, in the order of the permutation
    sums: dict[int, dict[int, int]] = {}
    for no, b, n in tagged.groupBy("__no", "__block").agg(F.sum("__size").alias("n")).collect():
        sums.setdefault(no, {})[b] = n
    rng = np.random.default_rng(how.seed)
    quotas, full, left_over = [], [], []
    for no, (_, blocks, whole, want, _, _) in enumerate(plan):
        taken, left, by_block = 0, want, sums.get(no, {})
        while want > 0 and taken < blocks and by_block.get(taken, 0) <= left:
            left -= by_block.get(taken, 0)
            taken += 1
        full.append(taken if want > 0 else 0)
        left_over.append(left if want > 0 and taken < blocks else 0.0)
        quotas.append(blocks * whole + full[-1] + (left_over[-1] > 0))
    # inside the block at the edge: the last hash that still brings the sum nearer to the target
    edge = F.broadcast(spark.createDataFrame([(no, full[no], left_over[no]) for no in range(len(plan)) if left_over[no] > 0], "__no int, __full int, __left double"))
    run = Window.partitionBy("__no").orderBy("__hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge_rows = tagged.join(edge, "__no").where("__block = __full").groupBy("__no", "__left", "__hash").agg(F.sum("__size").alias("n"))
    upto = edge_rows.withColumn("__upto", F.sum("n").over(run)).where(F.col("__upto") - F.col("n") / 2 <= F.col("__left"))
    limit = {r["__no"]: r["h"] for r in upto.groupBy("__no").agg(F.max("__hash").alias("h")).collect()}
    # units (epochs one after the other, blocks within) are permuted to unit * step + shift mod quota, then dealt
    dealt = split_quotas(rng, quotas, how.shards)
    rows = []
    for no, (source, blocks, whole, want, size, target) in enumerate(plan):
        quota = max(quotas[no], 1)
        step = next((x for x in (int(rng.integers(1, quota + 1)) for _ in range(200)) if math.gcd(x, quota) == 1), 1)
        ends = [sum(d[no] for d in dealt[: s + 1]) for s in range(how.shards)]
        rows.append((source, blocks, whole, want > 0, full[no], limit.get(no), quota, step, int(rng.integers(0, quota)), ends, size, target))
    return spark.createDataFrame(rows, "__source string, __blocks int, __whole int, __cut boolean, __full int, __limit bigint, __quota bigint, __step bigint, __shift bigint, __ends array<bigint>, __source_size bigint, __target double")


def _place(how: Mix, epoch: Column, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(how.seed), epoch.cast("int"), *columns)


def _block(hashed: Column) -> Column:
    return F.pmod(hashed, F.col("__blocks")).cast("int")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("__source", "__named")
    return rows.join(F.broadcast(named), rows["__source"].eqNullSafe(named["__named"])).drop("__named")


def draw(rows: DataFrame, plan: DataFrame, identity: list[str], how: Mix = Mix()) -> DataFrame:
    """rows (with __source) and __draws: an array of (epoch, shard, order), one for each time the mix takes the row.

    A projection over a broadcast of the plan: no shuffle, whatever share of the rows one source holds. Rows alike in
    all `identity` columns are drawn alike. Sort a shard by order for its local shuffle.
    """
    columns = [F.col(f"`{c}`") for c in identity]
    hashed = _place(how, F.col("__whole"), columns)
    in_cut = F.col("__cut") & ((_block(hashed) < F.col("__full")) | ((_block(hashed) == F.col("__full")) & (hashed <= F.col("__limit"))))
    times = F.col("__whole") + F.coalesce(in_cut, F.lit(False)).cast("int")
    unit = lambda e: F.pmod((e * F.col("__blocks") + _block(_place(how, e, columns))).cast("long") * F.col("__step") + F.col("__shift"), F.col("__quota"))
    each = lambda e: F.struct(e.alias("epoch"), F.size(F.filter("__ends", lambda end: end <= unit(e))).alias("shard"), F.xxhash64(F.lit(how.seed + 1), e, *columns).alias("order"))
    none = F.array().cast("array<struct<epoch:int,shard:int,order:bigint>>")
    return _with_source(rows, plan).withColumn("__draws", F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), each)).otherwise(none))


def mixed_words(docs: DataFrame, how: Mix = Mix(), id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """For every document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats
    counted), shards (where its copies go).

    A null text has size 0; documents without words ride with their block. Null is a source of its own; a source without
    words has target 0. Documents that repeat an id are drawn alike, be their texts alike or not; null ids likewise. Texts of
    any length are counted whole: a source's words come near its target by half a document's size. Other columns are not
    read, whatever their names; an empty table gives none.
    """
    base = sized(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source")), ["id"])
    drawn = draw(base, plan_mix(base, ["id"], how), ["id"], how)
    return drawn.select(
        F.col("id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.size("__draws") * F.col("__size")).cast("long").alias("taken"), F.transform("__draws", lambda d: d["shard"]).alias("shards"),
    )


def mixed_documents(docs: DataFrame, how: Mix = Mix(), id_column: str = "doc_id", text: str = "text", source: str = "source", shard: str = "__shard", order: str = "__order") -> DataFrame:
    """The mix itself: docs' rows with all their columns, each as often as it is drawn, with the columns `shard` and `order`
    (sort by it within the shard); columns of docs with those two names are replaced. Nulls, empty texts, repeats, long texts
    and empty tables as in `mixed_words`."""
    keep = [c for c in docs.columns if c.lower() not in (shard.lower(), order.lower())]
    named = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").cast("string").alias("__source"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    plan = plan_mix(sized(named.select("id", "text", "__source"), ["id"], source="__source"), ["id"], how)
    drawn = draw(named, plan, ["id"], how).withColumn("__draw", F.explode("__draws"))
    return drawn.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("__draw.shard").alias(shard), F.col("__draw.order").alias(order))
