"""Scenarios played on top of the history: each step sees the history and the earlier steps of its
own scenario, and the history itself is left as it is.

Nothing of the history is copied per scenario but the past of the scenario's own clients. Network counters are two running sums that add up:
the history's, in which a step is only a probe that adds nothing, and a small one per scenario and entity with what the steps change (the sessions of the scenario's
clients with the steps less the same without them). Components start from the history's as of the scenario's first step: every node a
scenario touches is looked up once, and the steps' links join those components, each scenario with names of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.functions.storage import stored
from riskloom.operators.client_features import client_features, client_state
from riskloom.operators.components import client_node, entity_nodes, links, merges, sizes_before
from riskloom.operators.entity_features import ORDER, SUMS, counters, entity_changes, filled
from riskloom.sources.transactions import normalise

KEYS = ["scenario_id", "tx_id"]


def observe(history_path: str, tx: DataFrame) -> None:
    """Add confirmed transactions to the stored history; the next run sees them."""
    tx.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(history_path)


def history(spark: SparkSession, history_path: str) -> DataFrame:
    """All transactions observed so far; ``day`` prunes files."""
    return spark.read.parquet(history_path)


def _own_past(history: DataFrame, scenarios: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The history of the scenarios' clients and their profiles, once per scenario; the client key is made of scenario and client, so
    scenarios do not see each other."""
    who = scenarios.select("scenario_id", "client_id").distinct()
    key = F.concat(F.col("scenario_id").cast("string"), F.lit("|"), F.col("client_id").cast("string"))
    past = history.join(who, "client_id").withColumns({"_client": F.col("client_id"), "client_id": key, "_step": F.lit(False)})
    return past, profiles.join(who, "client_id").withColumn("client_id", key).drop("scenario_id")


def replay(history: DataFrame, scenarios: DataFrame, profiles: DataFrame, places: DataFrame, network: bool = True,
           components: bool = True, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Features of every step (``scenario_id`` and the transaction columns); ``score`` then scores and decides the steps anew.

    A tx_id is used once in a scenario. Counters are as of each step, components as of the scenario's first step and the steps since."""
    past, own = _own_past(history, scenarios, profiles)
    key = F.concat(F.col("scenario_id").cast("string"), F.lit("|"), F.col("client_id").cast("string"))
    steps = scenarios.withColumns({"_client": F.col("client_id"), "client_id": key, "_step": F.lit(True)})
    state = stored(client_state(past.unionByName(steps, allowMissingColumns=True), own, places), "replay-state")
    d = client_features(state).where("_step").withColumn("client_id", F.col("_client")).drop("_client", "_step")
    if network:
        d = filled(d.join(network_counters(history, past, state), KEYS, "left"))
    if components:
        d = d.join(component_sizes(history, scenarios), KEYS)
    return score(d) if score else d


def network_counters(history: DataFrame, past: DataFrame, state: DataFrame) -> DataFrame:
    """The network counters of every step, by scenario_id and tx_id. ``past`` are the rows of the scenarios' clients without the steps, ``state`` is the
    client pass with them."""
    keep = ("scenario_id", "tx_id", "_step")
    with_steps, without = entity_changes(state, keep), entity_changes(client_state(past), keep)
    less = without.withColumns({c: (-F.col(c)).cast(without.schema[c].dataType) for c in SUMS.values()})
    at = ["scenario_id", "ent", "kind", *ORDER]
    changes = stored(
        with_steps.unionByName(less).groupBy(*at).agg(F.max("_step").alias("_step"), *[F.sum(c).alias(c) for c in SUMS.values()])
        .where(F.col("_step") | (F.col("total") != 0) | (F.col("day") != 0) | (F.col("week") != 0) | (F.col("count") != 0) | (F.col("money") != 0))
        .withColumn("_seen", F.when(F.col("_step") & (F.col("_cls") == 1), F.col("us"))), "replay-changes")
    mine = scan.running(changes, ["scenario_id", "ent"], ORDER, sums=SUMS, mins={"r_first": "_seen"}).where(F.col("_step") & (F.col("_cls") == 1))

    probe = changes.where(F.col("_step") & (F.col("_cls") == 1)).select(*at, F.lit(True).alias("_probe"))
    base = entity_changes(client_state(history)).withColumn("_seen", F.when(F.col("_cls") == 1, F.col("us")))
    both = base.unionByName(probe, allowMissingColumns=True).withColumns({c: F.coalesce(c, F.lit(0)) for c in SUMS.values()})
    theirs = scan.running(both, ["ent"], ORDER, sums=SUMS, mins={"r_first": "_seen"}).where("_probe")
    kept = [*KEYS, "kind", "us", *SUMS, "r_first"]
    return counters(mine.select(*kept).unionByName(theirs.select(*kept)), KEYS)


def component_sizes(history: DataFrame, scenarios: DataFrame) -> DataFrame:
    """component_clients and component_size of every step, by scenario_id and tx_id."""
    steps = normalise(scenarios).select(*KEYS, "us", client_node().alias("u"), entity_nodes().alias("e"))
    start = steps.groupBy("scenario_id").agg(F.min(F.struct("us", "tx_id")).alias("start"))
    touched = (steps.select("scenario_id", F.explode(F.concat(
        F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("own"))), F.transform("e", lambda x: F.struct(x["v"].alias("node"), F.lit(0).alias("own"))))).alias("n"))
        .select("scenario_id", "n.*").distinct().join(start, "scenario_id").select("scenario_id", "node", "own", "start.us", "start.tx_id"))
    found = stored(sizes_before(merges(links(normalise(history))), touched).select(
        "scenario_id", "node", F.xxhash64(F.col("scenario_id").cast("string"), "label").alias("label"),
        F.coalesce("clients", "own").cast("long").alias("c"), F.coalesce("nodes", F.lit(1)).cast("long").alias("n")), "replay-nodes")

    def known(side: str) -> DataFrame:
        return found.select("scenario_id", F.col("node").alias(side), F.col("label").alias(f"{side}_label"), F.col("c").alias(f"{side}c"), F.col("n").alias(f"{side}n"))

    steps = steps.join(known("u"), ["scenario_id", "u"])
    new = (steps.select("*", F.explode("e").alias("x")).withColumns({"v": F.col("x.v"), "part": F.col("x.part")}).join(known("v"), ["scenario_id", "v"])
           .where("u_label <> v_label").groupBy(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
           .agg(F.min(F.struct("us", "tx_id", "part")).alias("at"), *[F.first(c).alias(c) for c in ("uc", "un", "vc", "vn")])
           .select("u", "v", "at.us", "at.tx_id", "at.part", "uc", "un", "vc", "vn"))
    asked = steps.select(*KEYS, "us", F.col("u_label").alias("node"), "uc", "un")
    return sizes_before(merges(new), asked).select(
        *KEYS, F.coalesce("clients", "uc").cast("double").alias("component_clients"), F.coalesce("nodes", "un").cast("double").alias("component_size"))


def outcome(steps: DataFrame) -> DataFrame:
    """Last action, highest probability and total amount per scenario."""
    return steps.groupBy("scenario_id").agg(
        F.count("*").alias("steps"), F.max_by("action", F.struct("us", "tx_id")).alias("final_action"),
        F.max("p_fraud").alias("max_p_fraud"), F.sum("amount").alias("total_amount"))
