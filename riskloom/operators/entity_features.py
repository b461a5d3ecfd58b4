"""Point-in-time features of shared devices, addresses and recipients.

The distinct number of clients seen in a sliding window is the number of (entity, client) sessions
that are open: consecutive sightings no further apart than the window form one session. A session
adds 1 when it starts and takes 1 away one window after its last sighting, so every sliding or
cumulative count becomes a running sum over one narrow table of changes keyed by entity. Sightings
of a pair next to each other come from the client pass, which already has them side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.operators.client_features import MONEY, client_state
from riskloom.sources.transactions import DAY_US, normalise

KINDS = {"device": "device_id", "ip": "ip", "recipient": "recipient_id"}
ORDER = ["us", "_cls", "tx_id"]
WEEK_US = 7 * DAY_US


def _entity(kind: str) -> Column:
    return F.concat(F.lit(kind[0] + ":"), F.col(KINDS[kind]))


def hot_entities(tx: DataFrame) -> scan.Hot:
    seen = tx.select("us", "tx_id", F.explode(F.array(*[F.when(F.col(c) != "", _entity(k)) for k, c in KINDS.items()])).alias("ent"))
    return scan.find_hot(seen.where(F.col("ent").isNotNull()), ["ent"], ["us", "tx_id"])


def entity_changes(state: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """One row per sighting, plus one per session or amount that runs out later, with the columns to ``keep``."""

    def row(kind: str, us: Column, cls: int, total=0, day=0, week=0, count=0, money=None) -> Column:
        def num(x):
            return (x if isinstance(x, Column) else F.lit(x)).cast("long")

        return F.struct(
            _entity(kind).alias("ent"), F.lit(kind).alias("kind"), us.alias("us"),
            F.lit(cls).alias("_cls"), num(total).alias("total"), num(day).alias("day"),
            num(week).alias("week"), num(count).alias("count"),
            (F.lit(0) if money is None else money).cast(MONEY).alias("money"))

    rows = []
    for kind, col in KINDS.items():
        there = F.col(col) != ""
        us, prev, nxt = F.col("us"), F.col(f"h_prev_{kind}"), F.col(f"h_next_{kind}")
        money = F.col("amount").cast(MONEY)

        def starts(w):
            return F.when(prev.isNull() | (us - prev > w), 1).otherwise(0)

        def ends(w):
            return F.when(nxt.isNull() | (nxt - us > w), -1).otherwise(0)

        new = F.when(F.col(f"h_n_{kind}") == 0, 1).otherwise(0)
        if kind == "recipient":
            rows += [
                F.when(there, row(kind, us, 1, new, starts(DAY_US), starts(WEEK_US), 1, money)),
                F.when(there, row(kind, us + (DAY_US + 1), 0, 0, ends(DAY_US), 0, -1, -money)),
                F.when(there & (ends(WEEK_US) == -1), row(kind, us + (WEEK_US + 1), 0, week=-1)),
            ]
        else:
            rows += [
                F.when(there, row(kind, us, 1, new, starts(DAY_US))),
                F.when(there & (ends(DAY_US) == -1), row(kind, us + (DAY_US + 1), 0, day=-1)),
            ]
    exploded = state.select(*keep, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r"))
    return exploded.select(*keep, "r.*")


SUMS = {"r_total": "total", "r_day": "day", "r_week": "week", "r_count": "count", "r_money": "money"}


def counters(run: DataFrame, keys: list[str]) -> DataFrame:
    """The network counters per ``keys`` from running sums (``kind``, ``us``, ``r_...``); of several rows of a kind the sums add up."""
    def pick(kind: str, c, agg=F.sum):
        return agg(F.when(F.col("kind") == kind, F.col(c)))

    def at_least_one(kind: str, c):
        return F.greatest(pick(kind, c).cast("double"), F.when(pick(kind, c).isNotNull(), F.lit(1.0)))

    there, first = pick("recipient", "us", F.max), pick("recipient", "r_first", F.min)
    return run.groupBy(*keys).agg(
        at_least_one("device", "r_total").alias("clients_per_device"),
        at_least_one("ip", "r_total").alias("clients_per_ip"),
        at_least_one("recipient", "r_total").alias("clients_per_recipient"),
        pick("recipient", "r_day").cast("double").alias("recipient_clients_24h"),
        pick("recipient", "r_week").cast("double").alias("recipient_clients_7d"),
        pick("recipient", "r_count").cast("double").alias("recipient_inbound_24h"),
        F.log1p(pick("recipient", "r_money").cast("double")).alias("recipient_amount_24h"),
        F.when(there.isNotNull(), F.coalesce((there - first) / float(DAY_US), F.lit(0.0))).alias("recipient_age_days"),
        F.when(there.isNotNull(), F.when(first.isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).alias("recipient_is_new_to_bank"),
        at_least_one("device", "r_day").alias("device_clients_24h"),
        at_least_one("ip", "r_day").alias("ip_clients_24h"),
    )


def entity_features(tx: DataFrame, hot: scan.Hot | None = None, state: DataFrame | None = None) -> DataFrame:
    """tx_id with the network counters; transactions without any entity are absent. ``hot`` are the entities with many rows, ``state`` is the
    client pass over ``tx`` if there is one already."""
    if state is None:
        state = client_state(normalise(tx).select(
            "tx_id", "timestamp", "us", "client_id", "amount", *KINDS.values(), "city", "country", "merchant_category", "channel", "tx_type",
            "is_vpn", "remote_access", "call_minutes_before", "session_duration_s"))
    changes = entity_changes(state).withColumn("_seen", F.when(F.col("_cls") == 1, F.col("us")))
    # looked for among the plain transactions: their entities have the most changes too
    hot = hot or hot_entities(normalise(tx))
    run = scan.running(changes, ["ent"], ORDER, sums=SUMS, mins={"r_first": "_seen"}, hot=hot)
    return counters(run.where(F.col("_cls") == 1), ["tx_id"])


# value of each network counter when the transaction names no such entity
WITHOUT_ENTITY = {
    "clients_per_device": 1.0, "clients_per_ip": 1.0, "clients_per_recipient": 0.0,
    "recipient_clients_24h": 0.0, "recipient_clients_7d": 0.0, "recipient_inbound_24h": 0.0,
    "recipient_amount_24h": 0.0, "recipient_age_days": 0.0, "recipient_is_new_to_bank": 0.0,
    "device_clients_24h": 1.0, "ip_clients_24h": 1.0,
}


def with_entity_features(df: DataFrame, tx: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Add the network counters of ``tx`` to rows with its tx_id."""
    return filled(df.join(entity_features(tx, state=state), "tx_id", "left"))


def filled(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in WITHOUT_ENTITY.items()})
