"""Change streams: an append-only log of events, read with Structured Streaming.

The log is a folder of JSON lines, one event each: seq, time, ns (database, collection), operation, key and the document
as JSON. Writers append through `ChangeLog`; readers follow with a streaming query whose checkpoint is the resume token,
or start after a sequence number. Documents get the collection's schema back when they are read.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.core import Scope, quote
from ..operators.filters import compile_filter
from ..plans.pipeline import Context, Flow, single, stages

SCHEMA = "seq long, time timestamp_ntz, db string, coll string, operationType string, documentKey string, fullDocument string"
#: Stages of a stream's pipeline: one event at a time.
ALLOWED = ("$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$replaceWith")


class ChangeLog:
    """The writer's side. `retention`: how many events `compact` keeps. A log that is there is carried on: numbers go on
    behind its last event."""

    def __init__(self, database: Any, folder: str, retention: int = 10_000):
        self.database, self.folder, self.retention = database, folder, retention
        spark = database.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        self.last = (spark.read.schema(SCHEMA).json(folder).agg(F.max("seq")).first()[0] or 0) if there else 0
        database.listeners.append(self.append)

    def append(self, name: str, operation: str, rows: DataFrame | None) -> None:
        """Events for the rows of one write, numbered on from the last: documents as they are now, of deleted ones the keys.
        Without rows one event of the collection itself (drop, rename, invalidate)."""
        if rows is None:
            rows = self.database.spark.range(1).select(F.lit(None).cast("string").alias("_id"))
        key = F.col("_id").cast("string") if "_id" in rows.columns else F.lit(None).cast("string")
        bare = operation in ("delete", "drop", "rename", "invalidate")
        docs = F.lit(None).cast("string") if bare else F.to_json(F.struct(*[F.col(quote(c)) for c in rows.columns]))
        # numbers are ranges: a partition's offset is a running sum over partition counts
        tagged = rows.select(key.alias("documentKey"), docs.alias("fullDocument"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")).persist()
        counts = sorted((r["p"], r["count"]) for r in tagged.groupBy("p").count().collect())
        starts, at = {}, self.last
        for p, n in counts:
            starts[p], at = at, at + n
        if starts:
            first = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)])
            events = tagged.select((F.element_at(first, F.col("p")) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("seq"), F.current_timestamp().cast("timestamp_ntz").alias("time"), F.lit(self.database.name).alias("db"), F.lit(name).alias("coll"), F.lit(operation).alias("operationType"), "documentKey", "fullDocument")
            events.write.mode("append").json(self.folder)
        tagged.unpersist()
        self.last = at

    def compact(self, target: str) -> None:
        """The newest `retention` events in a new folder; readers resume there or learn that they are too late."""
        spark = self.database.spark
        log = spark.read.schema(SCHEMA).json(self.folder)
        log.where(F.col("seq") > self.last - self.retention).write.mode("overwrite").json(target)
        self.folder = target


def gaps(log: DataFrame) -> DataFrame:
    """Sequence numbers after which events are missing: after, before."""
    spans = log.select("seq").distinct()
    next_one = spans.select((F.col("seq") - 1).alias("seq"), F.lit(True).alias("followed"))
    ends = spans.join(next_one, "seq", "left").where("followed is null").select(F.col("seq").alias("after"))
    last = log.agg(F.max("seq").alias("last"))
    return ends.join(F.broadcast(last), F.col("after") < F.col("last")).select("after")


def watch(spark: SparkSession, folder: str, pipeline: list | None = None, db: str | None = None, coll: str | None = None, schema: Any = None, resume_after: int | None = None, start_at: Any = None, full_document: str = "default", streaming: bool = True) -> DataFrame:
    """A streaming DataFrame of events (or, with streaming=False, a batch over what is there).

    `schema`: of the documents; without it fullDocument stays JSON. resume_after: a sequence number (`seq` of an event).
    A batch over one collection ends with the event that invalidates it; a stream shows that event and goes on.
    """
    if full_document not in ("default", "updateLookup", "whenAvailable", "required"):
        raise QueryError("unknown fullDocument mode")
    reader = spark.readStream if streaming else spark.read
    log = reader.schema(SCHEMA).json(folder)
    if db is not None:
        log = log.where(F.col("db") == db)
    if coll is not None:
        log = log.where(F.col("coll") == coll)
    if resume_after is not None:
        oldest = spark.read.schema(SCHEMA).json(folder).agg(F.min("seq")).first()[0]
        if oldest is not None and oldest > resume_after + 1:
            raise QueryError("the stream cannot resume there: events are gone")
        log = log.where(F.col("seq") > resume_after)
    if not streaming and coll is not None:
        ended = log.where("operationType = 'invalidate'").agg(F.min("seq").alias("__sd_ended"))
        log = log.join(F.broadcast(ended), how="cross").where("__sd_ended is null or seq <= __sd_ended").drop("__sd_ended")  # one row
    if start_at is not None:
        log = log.where(F.col("time") >= F.lit(str(start_at)).cast("timestamp_ntz"))
    if schema is not None:
        log = log.withColumn("fullDocument", F.from_json("fullDocument", schema))
    if full_document == "default":
        log = log.withColumn("fullDocument", F.when(F.col("operationType").isin("insert", "replace"), F.col("fullDocument")))
    elif full_document == "required":
        log = log.withColumn("fullDocument", F.when(F.col("fullDocument").isNull() & F.col("operationType").isin("insert", "update", "replace"), F.raise_error(F.lit("an event has no document")).cast(log.schema["fullDocument"].dataType)).otherwise(F.col("fullDocument")))
    return transformed(log, pipeline or [], spark)


def transformed(events: DataFrame, pipeline: list, spark: SparkSession) -> DataFrame:
    """A stream through the stages that look at one event at a time, by the same compiler as batches."""
    flow = Flow(events, Context(spark, lambda name: (_ for _ in ()).throw(QueryError(f"no collection {name} in a stream"))))
    for spec in pipeline:
        name, body = single(spec)
        if name not in ALLOWED:
            raise QueryError(f"{name} is no stage of a change stream")
        flow = stages[name](flow, body, False)
    return flow.df


def windowed_counts(events: DataFrame, at: str, width: str, delay: str, *by: str) -> DataFrame:
    """Counts a time window and key of a stream, late events up to `delay` included: `$group` by `$dateTrunc`, streaming."""
    zoned = events.withColumn(at, F.col(at).cast("timestamp"))
    return zoned.withWatermark(at, delay).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def drain(df: DataFrame, checkpoint: str, name: str | None = None) -> DataFrame:
    """Everything the stream has now, as rows; the checkpoint remembers where it stopped (the next call goes on there)."""
    spark = df.sparkSession
    name = name or f"drained_{time.time_ns()}"
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def filtered(df: DataFrame, spec: dict) -> DataFrame:
    return df.where(compile_filter(spec, Scope.of(df.schema)))
