"""Reading, cleaning and ordering transactions, profiles and scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.sources import schema as S

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
                     "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")


def text(name: str) -> Column:
    """Missing strings, also those spelled out by a CSV writer, become the empty string."""
    c = F.col(name).cast("string")
    return F.when(c.isNull() | c.isin("nan", "None", "NaT"), "").otherwise(c)


def text_or(name: str, default: str) -> Column:
    c = text(name)
    return F.when(c == "", default).otherwise(c)


def number(name: str, default: float = 0.0) -> Column:
    """Anything that is not a number becomes the default."""
    c = F.col(name).try_cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(float(default))).otherwise(c)


def parse_timestamp(name: str) -> Column:
    c = F.col(name)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIMESTAMP_FORMATS])


def read_transactions(spark: SparkSession, path: str,
                      rejects: Observation | None = None) -> DataFrame:
    """CSV with mixed timestamp spellings. Rows without a readable time are dropped; pass an
    ``Observation`` to learn how many (metric ``rejected``) once an action that reads the file a
    single time has run (a global sort reads it twice)."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "timestamp" else f
                        for f in S.TRANSACTION_SCHEMA])
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in raw}
    fields = [known.get(n, T.StructField(n, T.StringType())) for n in header]
    df = spark.read.option("header", True).schema(T.StructType(fields)).csv(path)
    df = df.withColumn("timestamp", parse_timestamp("timestamp"))
    if rejects is not None:
        df = df.observe(rejects, F.count_if(F.col("timestamp").isNull()).alias("rejected"))
    return df.where(F.col("timestamp").isNotNull())


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in S.PROFILE_SCHEMA}
    fields = [known.get(n, T.StructField(n, T.StringType())) for n in header]
    return (spark.read.option("header", True).schema(T.StructType(fields)).csv(path)
            .select("client_id", "age", "home_city", "avg_ticket", "tenure_days"))


def normalise(df: DataFrame) -> DataFrame:
    """Fill gaps the way every feature expects them and add ``us``, epoch microseconds."""
    return (
        df.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))
        .withColumns({
            "amount": number("amount"),
            "device_id": text("device_id"),
            "ip": text("ip"),
            "city": text("city"),
            "country": text_or("country", "KZ"),
            "merchant_category": text_or("merchant_category", "grocery"),
            "channel": text_or("channel", "pos"),
            "tx_type": text_or("tx_type", "purchase"),
            "recipient_id": text("recipient_id"),
            "is_vpn": number("is_vpn"),
            "remote_access": number("remote_access"),
            "call_minutes_before": number("call_minutes_before"),
            "session_duration_s": number("session_duration_s"),
        })
    )


def with_profile(df: DataFrame, profiles: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Profile values, or the defaults for a client the profile table does not know. The profile
    table grows with the client base, so no broadcast is forced."""
    return (
        df.join(profiles, on or ["client_id"], "left")
        .withColumns({
            "age": F.coalesce(F.col("age").cast("double"), F.lit(float(S.DEFAULT_AGE))),
            "home_city": F.coalesce("home_city", F.lit(S.DEFAULT_HOME_CITY)),
            "avg_ticket": F.coalesce(F.col("avg_ticket").cast("double"), F.lit(S.DEFAULT_TICKET)),
            "tenure_days": F.coalesce(F.col("tenure_days").cast("double"),
                                      F.lit(float(S.DEFAULT_TENURE_DAYS))),
        })
    )


BROADCAST_PLACES = 200_000


def with_place(df: DataFrame, places: DataFrame, city: str = "city", lat: str = "lat",
               lon: str = "lon", country: str | None = None) -> DataFrame:
    """Coordinates of a city; an unknown one falls to the centre of the country."""
    dim = places.select(F.col("city").alias(city), F.col("lat").alias(lat), F.col("lon").alias(lon),
                        F.col("country").alias(country or "_country"))
    if places.count() <= BROADCAST_PLACES:  # one market holds most rows: no exchange by city
        dim = F.broadcast(dim)
    out = df.join(dim, city, "left")
    filled = {lat: F.coalesce(lat, F.lit(S.UNKNOWN_PLACE[0])),
              lon: F.coalesce(lon, F.lit(S.UNKNOWN_PLACE[1]))}
    if country:
        filled[country] = F.coalesce(country, F.lit(S.UNKNOWN_PLACE[2]))
    return out.withColumns(filled) if country else out.withColumns(filled).drop("_country")


def category_risk(name: str = "merchant_category") -> Column:
    table = F.create_map(*[F.lit(x) for kv in S.CATEGORY_RISK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(name)), F.lit(S.UNKNOWN_CATEGORY_RISK))


def code_of(name: str, codes: list[str]) -> Column:
    """Position in a code list, unknown codes count as the first."""
    return F.greatest(F.array_position(F.lit(codes), F.col(name)) - 1, F.lit(0)).cast("double")


def write_by_day(df: DataFrame, path: str, time_col: str = "timestamp") -> None:
    """Scored or feature tables are stored by day, so period reports prune partitions."""
    df.withColumn("day", F.to_date(time_col)).write.mode("overwrite").partitionBy("day").parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """Result tables of reports as JSON lines."""
    df.write.mode("overwrite").json(path)
