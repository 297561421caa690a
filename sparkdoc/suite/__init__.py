"""Registered queries over the benchmark tables: pipelines of the language and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.pipeline import Context, run
from ..sources.collection import Collection, Database

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def database(spark: SparkSession, sf_dir: str) -> Database:
    """All tables as collections; nothing is read before it is used."""
    made = Database(spark, name="bench")

    class Lazy(dict):
        def __missing__(self, name: str) -> DataFrame:
            if name not in TABLES:
                raise KeyError(name)
            self[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return self[name]

        def __contains__(self, name: object) -> bool:
            return name in TABLES or dict.__contains__(self, name)

    made.tables = Lazy()
    return made


def pipeline_query(table: str, pipeline: list) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir)
        return run(pipeline, db.tables[table], Context(spark, db.read))

    return query


def collection_query(table: str, use: Callable[[Collection], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: use(database(spark, sf_dir)[table])


def all_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    from . import collections, expressions, filters, groups, joins, stages, windows

    queries: dict[str, Any] = {}
    sql: dict[str, str] = {}
    for module in (filters, stages, groups, windows, joins, expressions, collections):
        for name, (query, text) in module.QUERIES.items():
            queries[name] = query
            if text:
                sql[name] = text
    return queries, sql
