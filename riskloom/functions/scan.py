"""Running aggregates "before me" that stay balanced when one key holds a large part of the rows.

A window partitioned by a hot key would put all its rows in one task. Here hot keys are looked for in a sample of the rows; without one the plan is
the plain window. With one, all rows are dealt by range of (key, order) and stored with the number of their part, so a hot key's timeline lies in as many
parts as it needs: its chunks. The windows then run per (key, chunk), and what a chunk needs of the chunks before it comes from a
carry table, which has a row for each part that a hot key reaches into. A row itself carries nothing but the number of its chunk. Results do not depend on where the
parts begin.

Set ``spark.riskloom.chunkRows`` to change the chunk size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.storage import saved, stored

DEFAULT_CHUNK_ROWS = 2_000_000
TASK_ROWS = 100_000  # rows of a wide table that one task sorts
MIN_PICKED = 3
BROADCAST_ROWS = 200_000  # above this many rows the small side is joined by shuffle


def chunk_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.riskloom.chunkRows", str(DEFAULT_CHUNK_ROWS)))


@dataclass(frozen=True)
class Hot:
    """Keys with many rows; ``table`` is None when there are none. ``parts`` is how many ranges make chunks of the wanted size, ``rows`` about
    how many rows were looked through."""

    keys: tuple[str, ...]
    table: DataFrame | None
    count: int
    parts: int
    rows: int = 0

    def bounded(self, df: DataFrame) -> DataFrame:
        """Tables with a row per hot key, or per part that one reaches into."""
        return F.broadcast(df) if self.count + self.parts <= BROADCAST_ROWS else df

    def flag(self, df: DataFrame) -> DataFrame:
        """Add ``_hot``: does the row's key have many rows?"""
        if self.table is None:
            return df.withColumn("_hot", F.lit(False))
        marked = self.bounded(self.table.withColumn("_hot", F.lit(True)))
        return df.join(marked, list(self.keys), "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def find_hot(df: DataFrame, keys: list[str], by: list[str], rows: int | None = None, least: int = MIN_PICKED) -> Hot:
    """Keys with about ``least`` times ``rows`` rows or more: one scan of the keys and the columns ``by`` that tell rows apart; rows whose hash is 0
    modulo ``rows`` are picked, counted by key within the tasks, and keys picked ``least`` times are hot."""
    rows = rows or chunk_rows(df.sparkSession)
    step = rows // 100 if rows % 100 == 0 else rows  # a finer sample tells how many rows there are
    ticket = F.xxhash64(*keys, *by)
    picked = df.where(F.pmod(ticket, F.lit(step)) == 0).groupBy(*keys).agg(
        F.count_if(F.pmod(ticket, F.lit(rows)) == 0).alias("_n"), F.count("*").alias("_fine"))
    count, total, fine = picked.agg(F.count_if(F.col("_n") >= least), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_fine"), F.lit(0))).first()
    table = saved(picked.where(F.col("_n") >= least).drop("_n", "_fine")) if count else None
    return Hot(tuple(keys), table, count, total + 1, fine * step)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """A wide table of about ``rows`` rows with equal keys together, about ``TASK_ROWS`` rows a task. Adaptive execution joins parts up to a size in bytes as
    shuffled, which says little of what windows need in memory, so the number of parts is given. Small tables are left to Spark."""
    spark = df.sparkSession
    if rows <= TASK_ROWS * spark.sparkContext.defaultParallelism:
        return df
    # not fewer than Spark's own, so that a join on the keys keeps this exchange
    return df.repartition(max(-(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def chunked(df: DataFrame, hot: Hot, order: list[str]) -> DataFrame:
    """Add ``_chunk`` and ``_hot``; the rows of a key that is not hot are all in chunk 0. With hot keys the rows are dealt by range and
    stored, so that a retry cannot move an edge."""
    d = hot.flag(df)
    if hot.table is None:
        return d.withColumn("_chunk", F.lit(0))
    dealt = d.repartitionByRange(hot.parts, *hot.keys, *order)
    return stored(dealt.withColumn("_chunk", F.when(F.col("_hot"), F.spark_partition_id()).otherwise(0)), "chunks")


def running(df: DataFrame, keys: list[str], order: list[str], *, sums: dict[str, str] | None = None,
            mins: dict[str, str] | None = None, maxs: dict[str, str] | None = None,
            lasts: dict[str, str] | None = None, hot: Hot | None = None) -> DataFrame:
    """Add aggregates over all earlier rows of the key (``order`` must be total and not null).

    Each mapping is output column -> input column. Sums start at 0, the others at null;
    ``lasts`` takes the latest value that is not null.
    """
    hot = hot or find_hot(df, keys, order)
    d = chunked(df, hot, order)
    parts = list(keys) + (["_chunk"] if hot.table is not None else [])
    before = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kinds = [(sums or {}, F.sum), (mins or {}, F.min), (maxs or {}, F.max),
             (lasts or {}, lambda c: F.last(c, ignorenulls=True))]
    local = {out: agg(src).over(before) for names, agg in kinds for out, src in names.items()}
    if hot.table is None:
        d = d.withColumns(local)
        return d.withColumns({o: F.coalesce(o, F.lit(0)) for o in (sums or {})}).drop("_chunk", "_hot")

    at = F.struct(*order)
    total = {
        **{f"_c_{o}": F.sum(s) for o, s in (sums or {}).items()},
        **{f"_c_{o}": F.min(s) for o, s in (mins or {}).items()},
        **{f"_c_{o}": F.max(s) for o, s in (maxs or {}).items()},
        **{f"_c_{o}": F.max_by(s, F.when(F.col(s).isNotNull(), at)) for o, s in (lasts or {}).items()},
    }
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.where("_hot").groupBy(*keys, "_chunk").agg(*[e.alias(n) for n, e in total.items()])
    carry = totals.select(
        *keys, "_chunk",
        *[agg(f"_c_{o}").over(earlier).alias(f"_c_{o}") for names, agg in kinds for o in names])
    d = d.withColumns(local).join(hot.bounded(carry), list(keys) + ["_chunk"], "left")
    merged = {o: F.coalesce(o, F.lit(0)) + F.coalesce(f"_c_{o}", F.lit(0)) for o in (sums or {})}
    merged |= {o: F.least(o, f"_c_{o}") for o in (mins or {})}
    merged |= {o: F.greatest(o, f"_c_{o}") for o in (maxs or {})}
    merged |= {o: F.coalesce(o, f"_c_{o}") for o in (lasts or {})}
    return d.withColumns(merged).drop("_chunk", "_hot", *[f"_c_{o}" for names, _ in kinds for o in names])


def global_index(df: DataFrame, order: list[str], name: str = "row_index",
                 rows: int | None = None) -> DataFrame:
    """Position of every row in the total order, from 0, without a single-task sort.

    Rows are dealt by range, numbered within their part and stored, so that a retry cannot move a boundary;
    the rows of the parts before are added from a table of one row per part. There are as many parts as
    shuffle partitions, or as it takes for about ``rows`` rows each."""
    parts = [] if rows is None else [max(1, -(-df.count() // rows))]
    dealt = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    # the upper bits of this number are the part, the lower 33 the place in it
    d = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    d = d.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return d.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
