"""From raw documents to a training mix: quality, near duplicates, benchmark passages, secrets, source weights.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and read
back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.storage import stored
from riskloom.llm import decontaminate, mixing, near_dedup, quality, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of all documents of the input."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near duplicates."""
    return near_dedup.keep_first(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes from, with size, source_size, target and taken."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", keep_first),
    ("benchmark_decontamination", keep_clean),
    ("secret_scans", mask_secrets),
    ("mixing_sources", mix_sources),
]

# A learned classifier has no SQL counterpart; the tests compare the later stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
