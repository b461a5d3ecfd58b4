"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.storage import stored


SMALL = 100_000


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least id among itself and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    return (tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))))


def _sum(edges: DataFrame) -> tuple:
    """Number and order-free checksums of the edges; a round that changes nothing ends the work."""
    return tuple(edges.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in range(2)]).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``links`` (a, b): label is the least node that can be reached.

    Rows with a null end or equal ends are no links. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest path. A star's centre may have any number
    of neighbours: it is only ever joined with its one least id, and adaptive execution splits it."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    before = None
    while (now := _sum(edges)) != before:
        before = now
        if now[0] <= SMALL:  # a few edges take longer to deal out than to work on
            edges = edges.coalesce(1)
        edges = stored(_smaller_to_least(_larger_to_least(edges).distinct()).distinct(), "edges")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
