"""Hubs of the link graph: devices and addresses used by several clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.transactions import normalise

HUB_KINDS = {"device": "device_id", "ip": "ip"}
TOP_HUBS = 40


def pair_totals(tx: DataFrame) -> DataFrame:
    """Per (kind, hub, client): transactions, amount, frauds. Partial aggregation absorbs hot hubs."""
    d = normalise(tx)
    hub = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in HUB_KINDS.items()]))
    return (d.select("client_id", "amount", "is_fraud", hub.alias("h")).where(F.col("h.key") != "")
            .groupBy("h.kind", "h.key", "client_id")
            .agg(F.count("*").alias("transactions"), F.sum("amount").alias("amount"),
                 F.sum(F.col("is_fraud").cast("long")).alias("fraud")))


def hub_summary(pairs: DataFrame, top: int = TOP_HUBS, min_clients: int = 2) -> DataFrame:
    """The hubs with most clients, ``top`` per kind; equal ones in order of their key."""
    g = (pairs.groupBy("kind", "key")
         .agg(F.count("*").alias("clients"), F.sum("transactions").alias("transactions"),
              F.sum("amount").alias("amount"), F.sum("fraud").alias("_fraud"))
         .where(F.col("clients") >= min_clients)
         .withColumn("fraud_share", F.col("_fraud") / F.greatest(F.col("transactions"), F.lit(1))).drop("_fraud"))
    best = [g.where(F.col("kind") == k).orderBy(F.desc("clients"), "key").limit(top) for k in HUB_KINDS]
    return best[0].unionByName(best[1])


def hub_members(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """Clients of the reported hubs. Flat rows: a popular hub may have any number of members."""
    # at most ``top`` hubs per kind
    return (pairs.join(F.broadcast(hubs.select("kind", "key")), ["kind", "key"], "left_semi")
            .select("kind", "key", "client_id", "transactions", "amount",
                    (F.col("fraud") / F.greatest(F.col("transactions"), F.lit(1))).alias("fraud_share")))


def graph_view(pairs: DataFrame, min_clients: int = 3, limit: int = 6,
               top: int = TOP_HUBS) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the picture: the first ``limit`` hubs per kind and their clients. A client
    shown under several hubs takes its numbers from the first one."""
    hubs = hub_summary(pairs, min(limit, top), max(min_clients, 2))
    place = F.when(F.col("kind") == "device", 0).otherwise(1)
    members = (hub_members(pairs, hubs)
               .join(F.broadcast(hubs.select("kind", "key", F.col("clients").alias("_size"))), ["kind", "key"]))
    first = members.groupBy("client_id").agg(
        F.min_by(F.struct("transactions", "amount", "fraud_share"),
                 F.struct(place, -F.col("_size"), "key")).alias("m"))
    client = F.concat(F.lit("client:"), F.col("client_id").cast("string"))
    hub = F.concat("kind", F.lit(":"), "key")
    nodes = hubs.select(hub.alias("id"), F.col("kind").alias("type"), F.col("key").alias("label"), "clients",
                        "transactions", "amount", "fraud_share").unionByName(
        first.select(client.alias("id"), F.lit("client").alias("type"),
                     F.col("client_id").cast("string").alias("label"), F.lit(None).cast("long").alias("clients"),
                     "m.transactions", "m.amount", "m.fraud_share"))
    edges = members.select(hub.alias("source"), client.alias("target"),
                           F.col("transactions").alias("weight"), "amount")
    return nodes, edges
