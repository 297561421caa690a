"""The mixing stage of the pipeline deals its rows to shards."""

import corpus_pipeline
from pyspark.sql import functions as F
from sparkdoc.llm import mixing


def test_partitions_hold_shuffled_shards(spark):
    rows = [(i, f"some words {i}", "en", "ab"[i % 2], 12) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == corpus_pipeline.COLUMNS
    got = [r.doc_id for r in mixed.withColumn("p", F.spark_partition_id()).collect()]  # in the order of the partitions
    dealt = mixing.mixed_documents(docs).orderBy("__shard", "__order").collect()
    assert len({r["__shard"] for r in dealt}) > 1
    assert got == [r.doc_id for r in dealt]
