"""Scenarios against the plain way: the whole feature build over the history and one scenario's steps, scenario by scenario."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import replay
from riskloom.operators.features import feature_frame
from riskloom.sources import fixtures as X
from riskloom.sources.schema import FEATURES

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


@pytest.fixture(scope="module")
def played(spark):
    """A history, and scenarios of several clients who use old and new devices, addresses and recipients, some of them the same in two scenarios."""
    tx = X.tx_events(spark, SF).where("tx_id % 4 = 0")
    end = tx.agg(F.max("us")).first()[0]
    rnd = random.Random(8)
    clients = [r[0] for r in tx.select("client_id").distinct().orderBy("client_id").limit(6).collect()] + [99_999, 99_998]
    rows = []
    for scenario in ("a", "b"):
        us = end
        for i in range(14):
            us += rnd.choice([1, 1, 3_600_000_000, DAY // 2, DAY, 3 * DAY])
            rows.append((scenario, 10_000_000 + i, us, rnd.choice(clients), rnd.choice(["D1", "D2", "DX", ""]), rnd.choice(["I1", "IX", "IY"]),
                         rnd.choice(["R1", "RX", "RY", ""]), float(rnd.randint(1, 40) * 500)))
    steps = spark.createDataFrame(rows, "scenario_id string, tx_id long, us long, client_id long, device_id string, ip string, recipient_id string, amount double")
    first = tx.select([c for c in tx.columns if c not in steps.columns and c != "timestamp"]).limit(1)
    steps = steps.join(F.broadcast(first)).withColumn("timestamp", F.timestamp_micros("us")).select("scenario_id", *tx.columns)
    return tx, steps


def test_replay_matches_a_full_build_per_scenario(spark, played):
    history, steps = played
    profiles, places = X.profiles(spark, SF), X.places(spark, SF)
    got = replay.replay(history, steps, profiles, places).select("scenario_id", "tx_id", *FEATURES).toPandas().set_index(["scenario_id", "tx_id"]).sort_index()
    assert len(got) == steps.count() == 28
    for scenario in ("a", "b"):
        own = steps.where(F.col("scenario_id") == scenario).drop("scenario_id")
        want = feature_frame(history.unionByName(own), profiles, places).where("tx_id >= 10000000").select("tx_id", *FEATURES)
        pd.testing.assert_frame_equal(got.loc[scenario], want.toPandas().set_index("tx_id").sort_index(), check_dtype=False, rtol=1e-9)


def test_replay_scores_anew_and_leaves_the_history(spark, played):
    history, steps = played
    before = history.agg(F.sum(F.xxhash64("tx_id", "us", "device_id").cast("decimal(38,0)"))).first()
    seen = replay.replay(history, steps.where("scenario_id = 'a'"), X.profiles(spark, SF), X.places(spark, SF), components=False,
                         score=lambda d: d.withColumns({"p_fraud": F.col("clients_per_device") / 100, "action": F.lit("hold")}))
    (out,) = replay.outcome(seen).collect()
    assert out["steps"] == 14 and out["final_action"] == "hold" and 0 < out["max_p_fraud"] < 1
    assert history.agg(F.sum(F.xxhash64("tx_id", "us", "device_id").cast("decimal(38,0)"))).first() == before
