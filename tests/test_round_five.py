"""The client pass is dealt to tasks by its number of rows, not by their bytes."""

import pandas as pd
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.operators.client_features import client_state, hot_clients
from tests.test_features import stream


def test_tasks_of_the_client_pass_hold_a_bounded_number_of_rows(spark, monkeypatch):
    rows = [{"client_id": f"C{i % 97}", "timestamp": f"2025-09-{1 + i // 100:02d} {i % 24:02d}:00:00", "device_id": f"D{i % 7}", "amount": 100.0 * (i % 13)}
            for i in range(1500)]
    rows[5]["client_id"] = None
    spark.conf.set("spark.riskloom.chunkRows", "10000")
    try:
        tx = stream(spark, rows).repartition(6).cache()
        hot = hot_clients(tx)
        assert hot.table is None and 500 < hot.rows < 3500  # a sample of one in a hundred

        def state():
            d = client_state(tx)
            sizes = d.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).toPandas()["n"]
            return d.toPandas().sort_values("tx_id").reset_index(drop=True), sizes

        plain, whole = state()
        monkeypatch.setattr(scan, "TASK_ROWS", 20)
        again, dealt = state()
        pd.testing.assert_frame_equal(plain, again)
        assert sum(whole) == sum(dealt) == 1500 and len(dealt) > 2 * len(whole) and max(dealt) < max(whole)
    finally:
        spark.conf.unset("spark.riskloom.chunkRows")


def test_chunks_of_large_clients_are_dealt_too(spark, monkeypatch):
    """A client with most rows, cut into chunks: the same state with any number of rows a task."""
    rows = [{"client_id": "C0" if i % 3 else f"C{i}", "timestamp": f"2025-09-{1 + i // 60:02d} {i % 24:02d}:00:00", "device_id": f"D{i % 5}"} for i in range(900)]
    spark.conf.set("spark.riskloom.chunkRows", "20")
    try:
        tx = stream(spark, rows).cache()
        got = []
        for most in (scan.TASK_ROWS, 10):
            monkeypatch.setattr(scan, "TASK_ROWS", most)
            assert hot_clients(tx).table is not None
            got.append(client_state(tx).toPandas().sort_values("tx_id").reset_index(drop=True))
        pd.testing.assert_frame_equal(got[0][sorted(got[0])], got[1][sorted(got[1])])
    finally:
        spark.conf.unset("spark.riskloom.chunkRows")


def test_small_tables_are_left_to_spark(spark):
    d = spark.range(1000)
    assert scan.dealt(d, ["id"], 1000) is d
