"""Sources: files as collections, with column pruning and pushed filters left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "sparkdoc", **more: str) -> SparkSession:
    """A session with what the engine relies on: UTC, ANSI arithmetic, adaptive execution."""
    builder = SparkSession.builder.appName(name)
    for key, value in (CONF | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def from_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a given schema: inference would read everything twice."""
    return spark.read.schema(schema).json(path)


def from_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of any shape as one variant column `doc`: paths resolve at run time."""
    from pyspark.sql import functions as F

    return spark.read.text(path).select(F.parse_json("value").alias("doc"))
