import os
import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.operators.client_features import client_features, client_state
from riskloom.operators.entity_features import entity_features
from riskloom.sources import fixtures as X
from riskloom.streaming import online

SF = "/root/testdata/sf0.001"
FEATURES = ["amount_to_avg", "amount_z", "amount_to_max", "hours_since_prev", "tx_count_1h", "tx_count_24h",
            "amount_24h_to_avg", "is_new_device", "device_age_days", "city_tx_share", "travel_speed_kmh",
            "is_new_recipient", "is_new_category", "night_share", "own_context", "history_len"]


@pytest.fixture
def stream(spark, tmp_path):
    """Events as a stream of four files, oldest first."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    tx = X.tx_events(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    src = str(tmp_path / "src")
    for q in range(4):
        tx.where(f"tx_id >= {q * 250} AND tx_id < {(q + 1) * 250}").coalesce(1).write.mode("append").parquet(src)
    yield tx, spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(src)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(df, spark, tmp_path):
    out = str(tmp_path / f"out-{uuid.uuid4().hex}")
    q = (df.writeStream.foreachBatch(online.append_to(out)).option("checkpointLocation", str(tmp_path / "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) >= 4  # one more without rows when timers are due
    return spark.read.parquet(out)


def test_client_features_match_batch(spark, stream, tmp_path):
    tx, s = stream
    got = run(online.stream_client_features(s, X.profiles(spark, SF), X.places(spark, SF)), spark, tmp_path)
    got = got.select("tx_id", *FEATURES).toPandas().set_index("tx_id").sort_index()
    want = client_features(client_state(tx, X.profiles(spark, SF), X.places(spark, SF)))
    want = want.select("tx_id", *FEATURES).toPandas().set_index("tx_id").sort_index()
    assert len(got) == len(want) == 1000
    assert (got - want).abs().max().max() < 1e-9


def test_entity_counters_match_batch(spark, stream, tmp_path):
    tx, s = stream
    got = run(online.stream_entity_counters(s), spark, tmp_path).toPandas()
    want = entity_features(tx).toPandas().set_index("tx_id")
    for kind, pairs in {"device": {"r_total": "clients_per_device", "r_day": "device_clients_24h"},
                        "ip": {"r_total": "clients_per_ip", "r_day": "ip_clients_24h"},
                        "recipient": {"r_total": "clients_per_recipient", "r_day": "recipient_clients_24h",
                                      "r_week": "recipient_clients_7d", "r_count": "recipient_inbound_24h"}}.items():
        part = got[got["kind"] == kind].set_index("tx_id")
        assert len(part) > 0
        for mine, theirs in pairs.items():
            a = part[mine]
            if theirs not in ("recipient_clients_24h", "recipient_clients_7d", "recipient_inbound_24h"):
                a = a.clip(lower=1)
            assert (a - want.loc[part.index, theirs]).abs().max() == 0, (kind, mine)


def still_held(spark, tmp_path, key):
    """Keys whose window rows are in the state at the end, and all keys that it knows."""
    def keys(variable):
        d = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", variable)
        if variable == "recent":
            d = d.option("flattenCollectionTypes", "true")
        return {r[0] for r in d.load().select(f"key.{key}").distinct().collect()}

    return keys("recent"), keys("totals")


def test_window_rows_of_idle_clients_leave_the_state(spark, stream, tmp_path):
    tx, s = stream
    run(online.stream_client_features(s, X.profiles(spark, SF), X.places(spark, SF), "1 hour"), spark, tmp_path)
    held, known = still_held(spark, tmp_path, "client_id")
    end = tx.agg(F.max("us")).first()[0]
    last = {r[0]: r[1] for r in tx.groupBy("client_id").agg(F.max("us")).collect()}
    assert known == set(last)
    assert held == {c for c, us in last.items() if us // 1000 + 1 + 24 * 3_600_000 > end // 1000 - 3_600_000}
    assert 0 < len(held) < len(known)
