"""Transaction, profile and place views over the provided star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("int").alias("city_id"),
        F.col("n_name").alias("city"),
        (F.col("n_nationkey") * 5 - 60).cast("double").alias("lat"),
        (F.col("n_nationkey") * 13 - 150).cast("double").alias("lon"),
        F.when(F.col("n_regionkey") < 3, "KZ").otherwise("XX").alias("country"),
    )


def tx_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").withColumn("k", k)
    t = e.select(
        F.col("event_id").alias("tx_id"),
        F.col("ts").alias("timestamp"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("client_id"),
        F.round(F.col("value") * 1000, 0).alias("amount"),
        F.col("event_type").alias("merchant_category"),
        F.when(F.col("event_type") == "purchase", "mobile_app")
         .when(F.col("event_type") == "signup", "atm")
         .when(F.col("event_type") == "click", "ecom").otherwise("pos").alias("channel"),
        F.when(F.col("event_type") == "purchase", "transfer")
         .when(F.col("event_type") == "signup", "withdrawal").otherwise("purchase").alias("tx_type"),
        F.concat(F.lit("D"), "k").alias("device_id"),
        F.concat(F.lit("I"), F.col("k") % 20).alias("ip"),
        ((F.col("user_id") + F.col("k")) % 25).cast("int").alias("city_id"),
        F.when(F.col("k") % 7 == 0, 1).otherwise(0).alias("is_vpn"),
        F.when(F.col("k") % 11 == 0, 1).otherwise(0).alias("remote_access"),
        F.when(F.col("k") % 13 == 0, F.col("k").cast("double") / 4).otherwise(F.lit(0.0))
         .alias("call_minutes_before"),
        (F.col("k") + 20).cast("double").alias("session_duration_s"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("R"), F.col("k") % 10)).otherwise("")
         .alias("recipient_id"),
        F.when((F.col("user_id") * 7 + F.col("k") * 13 + F.col("event_id")) % 50 == 0, 1).otherwise(0)
         .alias("is_fraud"),
        "k",
    )
    t = t.withColumn(
        "fraud_type",
        F.when(F.col("is_fraud") == 0, "").when(F.col("k") % 3 == 0, "stolen_card")
         .when(F.col("k") % 3 == 1, "social_eng").otherwise("fraud_ring"))
    return t.join(places(spark, sf).select("city_id", "city", "country"), "city_id", "left")


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    m = (F.col("tx_id") % 40).cast("double")

    def strong(rest: int):
        return F.when(F.col("k") % 3 == rest, F.lit(0.92)).otherwise(F.lit(0.04))

    return tx_events(spark, sf).withColumns({
        "p_fraud": F.when(F.col("is_fraud") == 1, (F.col("tx_id") % 65 + 30).cast("double") / 100)
                    .otherwise(m * m / 4000),
        "p_stolen_card": strong(0),
        "p_social_eng": strong(1),
        "p_fraud_ring": strong(2),
    })


def tx_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A second stream, full of equal timestamps."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    t = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("merchant_category"),
        F.lit("pos").alias("channel"),
        F.when(F.col("o_orderstatus") == "F", "transfer")
         .when(F.col("o_orderstatus") == "P", "withdrawal").otherwise("purchase").alias("tx_type"),
        F.concat(F.lit("D"), (F.col("o_orderkey") * 7) % 60).alias("device_id"),
        F.concat(F.lit("I"), F.col("o_custkey") % 37).alias("ip"),
        F.col("c_nationkey").cast("int").alias("city_id"),
        F.lit(0).alias("is_vpn"), F.lit(0).alias("remote_access"),
        F.lit(0.0).alias("call_minutes_before"), F.lit(60.0).alias("session_duration_s"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("R"), (F.col("o_orderkey") * 11) % 90))
         .otherwise("").alias("recipient_id"),
    )
    return t.join(places(spark, sf).select("city_id", "city", "country"), "city_id", "left")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").select(F.col("user_id").alias("client_id")).distinct()
    return (
        c.select(
            "client_id",
            (F.col("client_id") % 60 + 18).alias("age"),
            (F.col("client_id") % 25).cast("int").alias("city_id"),
            (F.col("client_id") % 20 * 3000 + 12000).cast("double").alias("avg_ticket"),
            (F.col("client_id") * 17 % 2900 + 20).alias("tenure_days"))
        .join(places(spark, sf).select("city_id", F.col("city").alias("home_city")), "city_id", "left")
        .drop("city_id")
    )
