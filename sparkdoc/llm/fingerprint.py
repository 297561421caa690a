"""Document fingerprints: a canonical exact digest, built from SQL functions only.

A text is canonicalised (NFKC, full case folding, NFKC again, every run of Unicode white space to one blank, no blank
at either end) and digested with two independently seeded xxhash64 values, 128 bits in all. Texts are grouped by digest
and, inside equal digests, by their bytes; should two canonical texts ever share a digest, the later class (by smallest
id) gets a numbered suffix. Likeness of an exact digest is 1 for equal and 0 for different canonical texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of the id order holds, about; the most buckets.
ROWS_PER_BUCKET, MOST_BUCKETS = 1500, 16384


def _nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text (null: empty). JVM functions only: ICU ships with Spark."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: xxhash64 of the bytes under two seeds."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(half(0), half(1))


def exact_classes(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each class of equal canonical texts: fingerprint, class_id (smallest id), copies, canon_sha256.

    Copies collapse before the shuffle (partial aggregation on digest and bytes), so a class that holds a third of all
    rows costs one row a task. Null texts count as empty; null ids never become a class_id unless all are null; an
    empty table gives none.
    """
    canon = df.select(F.col(f"`{id_column}`").alias("id"), canonical(F.col(f"`{text}`")).alias("canon"))
    grouped = canon.select("id", "canon", digest(F.col("canon")).alias("digest")).groupBy("digest", "canon").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    small = grouped.select("digest", F.sha2(F.col("canon"), 256).alias("canon_sha256"), "class_id", "copies")
    place = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("class_id").asc_nulls_last(), "canon_sha256"))
    return small.withColumn("place", place).select(
        F.when(F.col("place") == 1, F.col("digest")).otherwise(F.concat("digest", F.lit("-"), F.col("place").cast("string"))).alias("fingerprint"), "digest", "canon_sha256", "class_id", "copies", "place"
    )


def id_buckets(df: DataFrame, key: str, rows: int) -> tuple[list[int], int, int]:
    """Bounds (values of the key, at most MOST_BUCKETS) that cut df into ranges of about ROWS_PER_BUCKET rows; the least and greatest key."""
    n = min(MOST_BUCKETS, max(1, math.ceil(rows / ROWS_PER_BUCKET)))
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), (F.percentile_approx(key, shares, max(10_000, 4 * n)) if shares else F.lit(None)).alias("cuts")).first()
    return sorted({c for c in found["cuts"] or [] if c < found["hi"]}), found["lo"], found["hi"]


def bucket_of(key: Column, bounds: list[int]) -> tuple[Column, Column]:
    """(how many bounds lie below the key, the bound that follows them or null): a two-level search through literals."""
    if not bounds:
        return F.lit(0), F.lit(None).cast("long")
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    as_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda b: b < key))
    outer = below(as_array([p[-1] for p in parts]))  # parts that lie wholly below
    part = F.get(F.array(*[as_array(p) for p in parts]), outer)
    inner = below(part)
    return F.when(outer < len(parts), outer * step + inner).otherwise(F.lit(len(bounds))), F.when(outer < len(parts), F.get(part, inner)).cast("long")


def likeness(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of the next
    document in descending id order; after the last comes the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, copies, class_id.

    The order is a range partitioning by id: bounds are ids of the table, so the row before a range is the row (or
    rows) of its lower bound, of which that range gets a copy. No task sees more than a range. Null ids come last; rows
    that repeat an id follow each other by digest and text. A single row is its own neighbour. Other columns are not read.
    """
    base = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("canon", canonical(F.col("text")))
    base = base.select("doc_id", "key", "text", digest(F.col("canon")).alias("digest"), F.sha2(F.col("canon"), 256).alias("canon_sha256"))
    ids = df.select(F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(-(2**63))).alias("key"))
    rows = ids.count()
    bounds, _, last = id_buckets(ids, "key", rows)
    # a row also goes, as a ghost, into the range that starts after it; the greatest id goes before the first range
    home, bound = bucket_of(F.col("key"), bounds)
    ghosts = F.when(F.coalesce(bound == F.col("key"), F.lit(False)), F.array(home + 1)).otherwise(F.array().cast("array<int>"))
    wrap = F.when(F.col("key") == F.lit(last), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    places = F.concat(
        F.array(F.struct(home.cast("int").alias("bucket"), F.lit(2).alias("part"))),
        F.transform(ghosts, lambda b: F.struct(b.cast("int").alias("bucket"), F.lit(1).alias("part"))),
        F.transform(wrap, lambda b: F.struct(b.cast("int").alias("bucket"), F.lit(0).alias("part"))),
    )
    spread = base.withColumn("at", F.explode(places)).select("doc_id", "key", "text", "digest", "canon_sha256", F.col("at.bucket").alias("bucket"), F.col("at.part").alias("part"))
    order = Window.partitionBy("bucket").orderBy("part", "key", "digest", "text")
    lagged = spread.withColumn("next_text", F.lag("text").over(order)).withColumn("next_digest", F.lag("digest").over(order)).where("part = 2")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = lagged.select("doc_id", "digest", "canon_sha256", "text", "next_text", "next_digest", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half)).alias("edited"))
    forms = edited.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_digest", digest(F.col("edited_canon")))
    same = lambda a, b, left, right: F.when(a != b, F.lit(0.0)).otherwise((left == right).cast("double"))
    # bytes are compared only where digests agree, and equal raw bytes need no second canonical form
    forms = forms.withColumn("own_canon", F.when((F.col("digest") == F.col("edited_digest")) | (F.col("digest") == F.col("next_digest")), canonical(F.col("text"))).otherwise(F.lit("")))
    forms = forms.withColumn("next_canon", F.when(F.col("digest") == F.col("next_digest"), F.when(F.col("text") == F.col("next_text"), F.col("own_canon")).otherwise(canonical(F.col("next_text")))).otherwise(F.lit("")))
    out = forms.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "digest", "canon_sha256", "edited_digest",
        same(F.col("digest"), F.col("edited_digest"), F.col("own_canon"), F.col("edited_canon")).alias("near_edited"),
        same(F.col("digest"), F.coalesce("next_digest", "digest"), F.col("own_canon"), F.coalesce("next_canon", "own_canon")).alias("near_next"),
    )
    # digests that stand for several canonical texts: none in practice, then the join is with an empty table
    classes = exact_classes(df, id_column, text)
    clashing = classes.where("place > 1").select("digest").distinct()
    suffixed = classes.join(clashing, "digest", "left_semi").select("digest", "canon_sha256", "fingerprint")
    joined = out.join(suffixed, ["digest", "canon_sha256"], "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", "digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
