"""A training corpus from `documents`: toxicity, near copies, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame, which is
written as Parquet and read again. Near copies share five-word shingles with a similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdoc.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from sparkdoc.llm.util import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return ngram_join.drop_near_copies(docs, ngram_join.Jaccard(5, 80)).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occurred before go; every document stays, be it empty."""
    return suffix_dedup.drop_repeats(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Partitions are ranges of (shard, order), so that the files, one after the
    other, are the shuffled shards; a large shard spans several of them."""
    return mixing.mixed_documents(docs).repartitionByRange("__shard", "__order").sortWithinPartitions("__shard", "__order").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their digest and that of the bytes they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Several stages are beyond SQL (training, components, suffix arrays, BPE); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[F.col(c) for c in COLUMNS])
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
