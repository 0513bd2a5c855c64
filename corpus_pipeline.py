"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, langid, mixing, sharding, simhash
from graphloom.llm.common import read_table, scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of whose n-grams no language holds a fifth, go."""
    return langid.drop_unknown(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's word windows go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.sample(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, all columns, with its shard and slot (in the place of columns of these names)."""
    return sharding.add_shards(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", near_dedup),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("ring_sharding", sharded),
]

#: SimHash components and fitted language filters have no SQL form; tests/llm/test_corpus_ops.py (test_pipeline)
#: compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
