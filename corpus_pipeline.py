"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, mixing, near_dedup, quality, sharding
from tidewright.llm._spark import Scratch, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.drop_near_duplicates(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to what mixing.KEPT says of each domain; none is repeated, and clean good ones stay."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), kept=mixing.KEPT, ceiling=1.0)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot."""
    return sharding.shard(docs, shards=16)


STAGES = [
    ("quality", filter_quality),
    ("near_dedup", dedup_near),
    ("decontamination", remove_leaks),
    ("mixing", mix_domains),
    ("sharding", assign_shards),
]

#: Classifiers and sketches have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
