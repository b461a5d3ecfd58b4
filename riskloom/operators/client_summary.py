"""Summaries of clients and entities at the end of the stream or at a given time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.functions.rounding import half_up
from riskloom.sources import schema as S
from riskloom.sources.transactions import normalise, with_profile


def client_summary(tx: DataFrame, profiles: DataFrame, asof: int | None = None) -> DataFrame:
    """One row per client: ticket, count, largest amount, night share, profile. ``asof`` (epoch
    microseconds, exclusive) limits the history; the default is the whole stream."""
    d = normalise(tx)
    if asof is not None:
        d = d.where(F.col("us") < asof)
    g = d.groupBy("client_id").agg(
        F.count("*").alias("tx_count"), F.sum("amount").alias("_sum"), F.max("amount").alias("_max"),
        F.sum((F.hour("timestamp") < 6).cast("int")).alias("_night"))
    n = F.col("tx_count")
    return with_profile(g, profiles).select(
        "client_id", "age", "home_city", "tx_count",
        half_up((F.col("avg_ticket") * S.PRIOR_WEIGHT + F.col("_sum")) / (n + S.PRIOR_WEIGHT), 2).alias("avg_amount"),
        half_up("_max", 2).alias("max_amount"), "tenure_days",
        half_up(F.col("_night") / n, 3).alias("night_share"))


def client_usage(tx: DataFrame) -> DataFrame:
    """Devices and cities of a client by use: kind, value, uses, rank from 1. Equal use is ordered
    by first sighting. Kept flat, since nothing bounds how many devices one client may have."""
    d = normalise(tx)
    kinds = F.explode(F.array(
        F.struct(F.lit("device").alias("kind"), F.col("device_id").alias("value")),
        F.struct(F.lit("city").alias("kind"), F.col("city").alias("value")))).alias("u")
    g = (d.select("client_id", "us", "tx_id", kinds).where(F.col("u.value") != "")
         .groupBy("client_id", "u.kind", "u.value")
         .agg(F.count("*").alias("uses"), F.min(F.struct("us", "tx_id")).alias("_first"))
         .select("client_id", "kind", "value", "uses", (-F.col("uses")).alias("_less"),
                 F.col("_first.us").alias("_us"), F.col("_first.tx_id").alias("_tx"),
                 F.lit(1).cast("long").alias("_one")))
    r = scan.running(g, ["client_id", "kind"], ["_less", "_us", "_tx"], sums={"_rank": "_one"})
    return r.select("client_id", "kind", "value", "uses", (F.col("_rank") + 1).alias("use_rank"))


def with_client_value(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Attach the two numbers the cost model needs."""
    return df.join(summary.select(
        "client_id", F.col("avg_amount").alias("client_avg"),
        F.col("tx_count").cast("double").alias("client_count")), "client_id", "left")


def entity_first_seen(tx: DataFrame) -> DataFrame:
    d = normalise(tx)
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("entity"))
        for k, c in (("device", "device_id"), ("ip", "ip"), ("recipient", "recipient_id"))])).alias("e")
    return (d.select("us", kinds).where(F.col("e.entity") != "")
            .groupBy("e.kind", "e.entity").agg(F.min("us").alias("first_us")))


def resolve_defaults(requests: DataFrame, tx: DataFrame, profiles: DataFrame,
                     now: str = "2025-10-01 12:00:00") -> DataFrame:
    """Fill what a scoring request left out from what is known about its client. Requests of clients
    in neither the history nor the profiles are left out; :func:`unknown_clients` lists them."""
    known = _known_clients(tx, profiles)
    top = (client_usage(tx).where((F.col("kind") == "device") & (F.col("use_rank") == 1))
           .select("client_id", F.col("value").alias("_top_device")))
    d = with_profile(requests.join(known, "client_id", "left_semi"), profiles).join(top, "client_id", "left")

    def given(name):
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name))

    cid = F.col("client_id").cast("string")
    return d.withColumns({
        "timestamp": F.coalesce(F.col("timestamp"), F.lit(now).cast("timestamp")),
        "city": F.coalesce(given("city"), F.col("home_city")),
        "device_id": F.coalesce(given("device_id"), F.col("_top_device"), F.concat(cid, F.lit("-dev"))),
        # a stable filler address per client
        "ip": F.coalesce(given("ip"), F.concat(
            F.lit("10."), (F.crc32(F.encode(cid, "UTF-8")) % 250).cast("string"), F.lit(".0.1"))),
        "recipient_id": F.when(F.col("tx_type") == "transfer",
                               F.coalesce(given("recipient_id"), F.lit("R00000"))).otherwise(F.col("recipient_id")),
    }).drop("_top_device", "age", "home_city", "avg_ticket", "tenure_days")


def _known_clients(tx: DataFrame, profiles: DataFrame) -> DataFrame:
    return tx.select("client_id").unionByName(profiles.select("client_id")).distinct()


def unknown_clients(requests: DataFrame, tx: DataFrame, profiles: DataFrame) -> DataFrame:
    return requests.join(_known_clients(tx, profiles), "client_id", "left_anti")
