"""The queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (bpe, decontaminate, fingerprint, hard_negatives, html_text, language, lm_score, merkle, mixing, near_dedup, quality,
                          secrets, warc)
from riskloom.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op2_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(table(spark, sf, "documents"))


@query
def op3_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf, "pages"))


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.scan(table(spark, sf, "documents")))


@query
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf, "pages"))


@query
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf, "documents"))


@query
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf, "documents"))


@query
def op9_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query
def op10_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Language-model scores of every document."""
    return lm_score.scores(table(spark, sf, "documents"))


@query
def op11_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document, and the text that they spell."""
    import public_tokenizers

    automaton = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    found = bpe.decode(bpe.encode(table(spark, sf, "documents"), automaton), automaton)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hard_negatives.mine(table(spark, sf, "embeddings"))


@query
def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's proof, folded from a tampered leaf in a seventh of them."""
    return merkle.digest(merkle.proofs(table(spark, sf, "documents")))
