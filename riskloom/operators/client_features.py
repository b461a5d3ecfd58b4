"""Point-in-time features that come from the client's own history.

Everything runs on one shuffle by client: windows over (client), (client, device), (client, city),
(client, category), (client, recipient) and (client, ip) all reuse that distribution. A client with
a very long history is dealt to chunks by range of time; what earlier chunks know travels as a few extra rows at the
chunk edges, so no window ever needs the whole client in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.functions.geo import haversine_km
from riskloom.sources import schema as S
from riskloom.sources.transactions import (DAY_US, HOUR_US, category_risk, code_of, normalise,
                                           with_place, with_profile)

ORDER = ["us", "_cls", "tx_id"]  # _cls: 0 an expiry, 1 a transaction
FAMILIES = {"device": "device_id", "city": "city", "category": "merchant_category",
            "recipient": "recipient_id", "ip": "ip"}
MONEY = "decimal(28,4)"  # sums that are added and taken away again stay exact


def _measures(d: DataFrame) -> DataFrame:
    """What one transaction adds to the history of its client."""
    return d.withColumns({
        "m_n": F.lit(1).cast("long"),
        "m_sum": F.col("amount"),
        "m_sq": F.col("amount") * F.col("amount"),
        "m_max": F.col("amount"),
        "m_night": (F.hour("timestamp") < 6).cast("long"),
        "m_money": F.col("amount").cast(MONEY),
        "m_x1": F.lit(0).cast("long"),
        "m_x24": F.lit(0).cast("long"),
        "m_xmoney": F.lit(0).cast(MONEY),
        "m_at": F.struct("us", "lat", "lon"),
        **{f"n_{f}": F.lit(1).cast("long") for f in FAMILIES},
        **{f"f_{f}": F.col("us") for f in FAMILIES},
    })


def _expiries(d: DataFrame, hot: scan.Hot) -> DataFrame:
    """Extra rows for hot clients: what leaves the last hour and the last day."""
    expiry = hot.flag(d).where("_hot").select(
        "client_id", "tx_id", "m_money", "us",
        F.explode(F.array(F.lit(1), F.lit(24))).alias("_hours"))
    return expiry.select(
        "client_id", "tx_id", F.lit(0).alias("_cls"),
        (F.col("us") + F.col("_hours") * F.lit(HOUR_US) + 1).alias("us"),
        (F.col("_hours") == 1).cast("long").alias("m_x1"),
        (F.col("_hours") == 24).cast("long").alias("m_x24"),
        F.when(F.col("_hours") == 24, F.col("m_money")).otherwise(F.lit(0)).cast(MONEY).alias("m_xmoney"))


def _edge_rows(chunks: DataFrame) -> DataFrame:
    """Extra rows for hot clients: per chunk the state carried in from earlier chunks plus the next sighting in later ones."""
    hot, expiry = (chunks.where(F.col("_hot") & (F.col("_cls") == c)) for c in (1, 0))

    # one row per (client, chunk, family, value); the client itself is the family "client"
    seen = hot.select(
        "client_id", "_chunk", "us", "tx_id", "m_n", "m_sum", "m_sq", "m_max", "m_night", "m_money",
        F.lit(0).cast("long").alias("m_x1"), F.lit(0).cast("long").alias("m_x24"),
        F.lit(0).cast(MONEY).alias("m_xmoney"), "m_at",
        F.explode(F.array(
            F.struct(F.lit("client").alias("fam"), F.lit("").alias("val")),
            *[F.struct(F.lit(f).alias("fam"), F.col(c).alias("val")) for f, c in FAMILIES.items()]))
        .alias("fv")).select("*", "fv.fam", "fv.val").drop("fv")
    gone = expiry.select("client_id", "_chunk", F.lit("client").alias("fam"), F.lit("").alias("val"),
                         "m_x1", "m_x24", "m_xmoney")
    sums = ["m_n", "m_sum", "m_sq", "m_night", "m_money", "m_x1", "m_x24", "m_xmoney"]
    per_chunk = (
        seen.unionByName(gone, allowMissingColumns=True)
        .groupBy("client_id", "fam", "val", "_chunk")
        .agg(*[F.sum(c).alias(c) for c in sums], F.max("m_max").alias("m_max"),
             F.min("us").alias("_first"), F.max("us").alias("_last"),
             F.max_by("m_at", F.when(F.col("m_at").isNotNull(), F.struct("us", "tx_id"))).alias("m_at")))
    by = Window.partitionBy("client_id", "fam", "val").orderBy("_chunk")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        "client_id", "fam", "val", "_chunk",
        *[F.sum(c).over(past).alias(c) for c in sums], F.max("m_max").over(past).alias("m_max"),
        F.last("m_at", ignorenulls=True).over(past).alias("m_at"),
        F.min("_first").over(past).alias("_first"), F.max("_last").over(past).alias("_last"),
        F.lead("_first").over(by).alias("_next"))
    side = F.explode(F.array(F.lit(0), F.lit(2))).alias("_pos")
    edge = carried.select("*", side).where(
        ((F.col("_pos") == 0) & F.col("_last").isNotNull())
        | ((F.col("_pos") == 2) & F.col("_next").isNotNull() & (F.col("fam") != "client")))

    def only(fam: str, c):
        return F.when((F.col("fam") == fam) & (F.col("_pos") == 0), c)

    edge = edge.select(
        "client_id", "_chunk", "_pos", F.lit(1).alias("_cls"),
        F.when(F.col("_pos") == 0, F.col("_last")).otherwise(F.col("_next")).alias("us"),
        *[only("client", F.col(c)).alias(c) for c in sums + ["m_max", "m_at"]],
        *[only(f, F.col("m_n")).alias(f"n_{f}") for f in FAMILIES],
        *[only(f, F.col("_first")).alias(f"f_{f}") for f in FAMILIES],
        *[F.when(F.col("fam") == f, F.col("val")).alias(c) for f, c in FAMILIES.items()])
    return edge


def _per_chunk(profiles: DataFrame, chunks: DataFrame, hot: scan.Hot) -> DataFrame:
    """One copy of a profile per chunk of its client, so a large client is joined chunk by chunk."""
    if hot.table is None:
        return profiles
    more = chunks.where("_hot").groupBy("client_id").agg(F.collect_set("_chunk").alias("_chunks"))  # as many as the client has parts
    return profiles.join(hot.bounded(more), "client_id", "left").withColumn(
        "_chunk", F.explode(F.coalesce("_chunks", F.array(F.lit(0))))).drop("_chunks")


def hot_clients(tx: DataFrame) -> scan.Hot:
    return scan.find_hot(normalise(tx).select("client_id", "us", "tx_id"), ["client_id"], ["us", "tx_id"])


def client_state(tx: DataFrame, profiles: DataFrame | None = None, places: DataFrame | None = None,
                 hot: scan.Hot | None = None) -> DataFrame:
    """Transactions with everything known about their client just before them. Without profiles and
    places only what comes from the transactions themselves is added, which is all the network
    pass needs."""
    hot = hot or hot_clients(tx)
    d = normalise(tx).drop("lat", "lon").withColumn("_cls", F.lit(1))
    # without hot clients ``_chunk`` is a constant; it stays out of the keys so the profile join and all
    # windows share one exchange
    parts = ["client_id"] if hot.table is None else ["client_id", "_chunk"]
    unknown = F.lit(None).cast("double")
    d = _measures(with_place(d, places) if places is not None else d.withColumns({"lat": unknown, "lon": unknown}))
    if hot.table is not None:
        d = d.unionByName(_expiries(d, hot), allowMissingColumns=True)
    d = scan.chunked(d, hot, ORDER)
    edge = _edge_rows(d) if hot.table is not None else None
    if edge is None:
        d = scan.dealt(d, parts, hot.rows)
    if profiles is not None:
        d = with_profile(d, _per_chunk(profiles, d, hot), parts)
    d = d.withColumn("_pos", F.lit(1))
    if edge is not None:
        d = scan.dealt(d.unionByName(edge, allowMissingColumns=True), parts, hot.rows)

    order = ["us", "tx_id"] if hot.table is None else ["_pos", "us", "_cls", "tx_id"]
    own = Window.partitionBy(*parts).orderBy(*order)
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    older = Window.partitionBy(*parts).orderBy("us")
    hour_ago = older.rangeBetween(Window.unboundedPreceding, -(HOUR_US + 1))
    day_ago = older.rangeBetween(Window.unboundedPreceding, -(DAY_US + 1))

    def total(c):
        return F.coalesce(F.sum(c).over(past), F.lit(0))

    def expired(flagged: str, measure: str, frame):
        """Other clients read their old rows by range, hot ones add up expiry rows."""
        ranged = F.coalesce(F.sum(measure).over(frame), F.lit(0))
        return ranged if hot.table is None else F.when(F.col("_hot"), total(flagged)).otherwise(ranged)

    cols = {
        "h_n": total("m_n"), "h_sum": total("m_sum"), "h_sq": total("m_sq"),
        "h_night": total("m_night"), "h_max": F.coalesce(F.max("m_max").over(past), F.lit(0.0)),
        "h_prev": F.last("m_at", ignorenulls=True).over(past),
        "h_1h": total("m_n") - expired("m_x1", "m_n", hour_ago),
        "h_24h": total("m_n") - expired("m_x24", "m_n", day_ago),
        "h_money_24h": total("m_money") - expired("m_xmoney", "m_money", day_ago),
    }
    for f, c in FAMILIES.items():
        mine = Window.partitionBy(*parts, c).orderBy(*order)
        cols[f"h_n_{f}"] = F.coalesce(
            F.sum(f"n_{f}").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cols[f"h_first_{f}"] = F.min(f"f_{f}").over(mine.rowsBetween(Window.unboundedPreceding, -1))
        cols[f"h_prev_{f}"] = F.lag("us").over(mine)
        cols[f"h_next_{f}"] = F.lead("us").over(mine)
    out = d.withColumns(cols)
    if hot.table is not None:
        out = out.where((F.col("_pos") == 1) & (F.col("_cls") == 1))
    drop = [c for c in out.columns if c.startswith(("m_", "n_", "f_"))]
    out = out.drop("_pos", "_cls", "_chunk", "_hot", *drop)
    return with_place(out, places, "home_city", "home_lat", "home_lon") if profiles is not None else out


def _flag(cond):
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def client_features(state: DataFrame) -> DataFrame:
    """The features of one client's history, session and profile from :func:`client_state`."""
    c = F.col
    n = c("h_n").cast("double")
    mean = (c("avg_ticket") * S.PRIOR_WEIGHT + c("h_sum")) / (n + S.PRIOR_WEIGHT)
    d = state.withColumn("_mean", mean)
    raw_mean = F.try_divide(c("h_sum"), n)
    var = F.greatest(F.try_divide(c("h_sq"), n) - raw_mean * raw_mean, F.lit(0.0))
    std = F.when(c("h_n") < 2, c("_mean") * 0.8).otherwise(F.greatest(F.sqrt(var), c("_mean") * 0.15))
    d = d.withColumns({
        "_std": std,
        "_gap_h": F.least(F.coalesce((c("us") - c("h_prev.us")) / float(HOUR_US), F.lit(720.0)), F.lit(720.0)),
        "_km_prev": F.coalesce(
            haversine_km(c("h_prev.lat"), c("h_prev.lon"), c("lat"), c("lon")), F.lit(0.0)),
        # an empty device or city is never remembered
        "_n_dev": F.when(c("device_id") == "", 0).otherwise(c("h_n_device")),
        "_n_city": F.when(c("city") == "", 0).otherwise(c("h_n_city")),
    })

    def share(x):
        return F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))

    has_recipient = c("recipient_id") != ""
    return d.withColumns({
        "log_amount": F.log1p("amount"),
        "amount_to_avg": c("amount") / F.greatest(c("_mean"), F.lit(1.0)),
        "amount_z": (c("amount") - c("_mean")) / F.greatest(c("_std"), F.lit(1.0)),
        "amount_to_max": F.when(c("h_max") > 0, c("amount") / F.greatest(c("h_max"), F.lit(1.0)))
                          .otherwise(F.lit(1.0)),
        "is_amount_record": _flag((c("h_n") >= 3) & (c("amount") > c("h_max"))),
        "is_round_amount": _flag((c("amount") >= 10000) & (F.pmod(c("amount"), F.lit(10000.0)) < 1e-6)),
        "hour": F.hour("timestamp").cast("double"),
        "is_night": _flag(F.hour("timestamp") < 6),
        "is_weekend": _flag(F.weekday("timestamp") >= 5),
        "hours_since_prev": c("_gap_h"),
        "tx_count_1h": c("h_1h").cast("double"),
        "tx_count_24h": c("h_24h").cast("double"),
        "amount_24h_to_avg": (c("h_money_24h").cast("double") + c("amount"))
                             / F.greatest(c("_mean"), F.lit(1.0)),
        "is_new_device": _flag(c("_n_dev") == 0),
        "device_tx_share": share(c("_n_dev")),
        "device_age_days": F.when(c("_n_dev") > 0, (c("us") - c("h_first_device")) / float(DAY_US))
                            .otherwise(F.lit(0.0)),
        "is_new_city": _flag(c("_n_city") == 0),
        "city_tx_share": share(c("_n_city")),
        "is_foreign": _flag(c("country") != "KZ"),
        "distance_from_home_km": haversine_km(c("home_lat"), c("home_lon"), c("lat"), c("lon")),
        "distance_from_prev_km": c("_km_prev"),
        "travel_speed_kmh": F.least(c("_km_prev") / F.greatest(c("_gap_h"), F.lit(1 / 60.0)),
                                    F.lit(100000.0)),
        "is_new_recipient": _flag(has_recipient & (c("h_n_recipient") == 0)),
        "has_long_call": _flag(c("call_minutes_before") >= 5),
        "category_risk": category_risk(),
        "is_new_category": _flag(c("h_n_category") == 0),
        "channel_code": code_of("channel", S.CHANNELS),
        "tx_type_code": code_of("tx_type", S.TX_TYPES),
        "is_transfer": _flag(c("tx_type") == "transfer"),
        "client_age": c("age"),
        "client_tenure_days": c("tenure_days"),
        "history_len": n,
        "night_share": share(c("h_night")),
        "own_context": _flag((c("_n_dev") > 0) & (c("_n_city") > 0) & (c("is_vpn") == 0)),
    }).drop("_mean", "_std", "_gap_h", "_km_prev", "_n_dev", "_n_city")
