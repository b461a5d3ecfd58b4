"""Exact interpolated quantiles per group, from value counts and running totals.

``percentile`` keeps every distinct value of a group in one task; here values are counted first and
the counts are scanned, so a group of any size stays distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.functions.storage import saved


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
              weight: str | None = None, few_groups: bool = True) -> DataFrame:
    """One row per group: keys, ``n`` and ``q``, the values at ``probs`` in order. With ``weight``
    the rows are value counts already. ``few_groups`` says that the groups (features, folds, the
    whole table) are few enough for one row each to be broadcast."""
    times = F.sum(weight) if weight else F.count("*")
    counts = saved(df.groupBy(*keys, value).agg(times.alias("_n")))
    pos = scan.running(counts, keys, [value], sums={"_from": "_n"})
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    pos = pos.join(F.broadcast(sizes) if few_groups else sizes, keys)
    at = F.array(*[F.lit(float(p)) for p in probs])
    # each wanted position needs the values at its floor and its ceiling
    wanted = F.explode(F.filter(
        F.transform(at, lambda p, i: F.struct(
            i.alias("i"),
            F.floor(p * (F.col("n") - 1)).alias("lo"),
            F.ceil(p * (F.col("n") - 1)).alias("hi"),
            (p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))).alias("w"))),
        lambda s: ((s["lo"] >= F.col("_from")) & (s["lo"] < F.col("_from") + F.col("_n")))
        | ((s["hi"] >= F.col("_from")) & (s["hi"] < F.col("_from") + F.col("_n")))))
    hit = pos.select(*keys, value, "n", "_from", "_n", wanted.alias("s"))

    def inside(side: str):
        c = F.col(f"s.{side}")
        return F.when((c >= F.col("_from")) & (c < F.col("_from") + F.col("_n")), F.col(value))

    one = hit.groupBy(*keys, "s.i").agg(
        F.max("n").alias("n"), F.max("s.w").alias("w"),
        F.max(inside("lo")).alias("lo"), F.max(inside("hi")).alias("hi"))
    one = one.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w"))
    # at most len(probs) entries per group
    return one.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))
