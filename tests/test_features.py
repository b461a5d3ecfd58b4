import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators.client_features import hot_clients
from riskloom.operators.components import component_features
from riskloom.operators.features import feature_frame
from riskloom.sources import fixtures as X
from riskloom.sources.schema import DEFAULT_AGE, FEATURES, places
from riskloom.sources.transactions import normalise

DEFAULTS = dict(client_id="C1", timestamp="2025-09-10 14:00:00", amount=10000.0, merchant_category="grocery", channel="pos",
                tx_type="purchase", device_id="D1", ip="1.2.3.4", city="Алматы", country="KZ", is_vpn=0, remote_access=0,
                call_minutes_before=0.0, session_duration_s=90.0, recipient_id="")


def stream(spark, rows):
    pdf = pd.DataFrame([{**DEFAULTS, "tx_id": f"T{i:04d}", **r} for i, r in enumerate(rows)])
    return spark.createDataFrame(pdf).withColumn("timestamp", F.to_timestamp("timestamp"))


def features(spark, rows, profiles=()):
    prof = spark.createDataFrame(list(profiles), "client_id string, age int, home_city string, avg_ticket double, tenure_days int")
    d = feature_frame(stream(spark, rows), prof, places(spark))
    return d.select("tx_id", *[d[f].cast("double").alias(f) for f in FEATURES]).toPandas().sort_values("tx_id").reset_index(drop=True)


def test_first_transaction_sees_nothing(spark):
    f = features(spark, [{}]).iloc[0]
    assert f.history_len == 0 and f.is_new_device == 1 and f.is_new_city == 1 and f.tx_count_24h == 0
    assert f.hours_since_prev == 720 and f.amount_to_max == 1 and f.clients_per_device == 1 and f.component_size == 1
    assert f.client_age == DEFAULT_AGE and f.amount_to_avg == pytest.approx(10000 / 12000)


def test_later_rows_do_not_change_earlier_ones(spark):
    rows = [{"timestamp": f"2025-09-10 1{i}:00:00", "amount": 1000.0 * (i + 1), "device_id": f"D{i % 2}"} for i in range(6)]
    short, full = features(spark, rows[:3]), features(spark, rows)
    pd.testing.assert_frame_equal(short, full.iloc[:3])


def test_day_window_keeps_its_old_edge(spark):
    f = features(spark, [{"timestamp": "2025-09-10 14:00:00"}, {"timestamp": "2025-09-11 14:00:00"}, {"timestamp": "2025-09-12 14:00:01"}])
    assert f.tx_count_24h.tolist() == [0, 1, 0]


def test_equal_times_are_ordered_by_id(spark):
    f = features(spark, [{} for _ in range(4)])
    assert f.tx_count_1h.tolist() == [0, 1, 2, 3] and f.history_len.tolist() == [0, 1, 2, 3]


def test_missing_recipients_do_not_merge_clients(spark):
    f = features(spark, [{"client_id": f"C{i}", "device_id": f"D{i}", "ip": f"1.1.1.{i}", "tx_type": "transfer",
                          "recipient_id": r, "timestamp": f"2025-09-10 14:0{i}:00"} for i, r in enumerate(["nan", None, "None", ""])])
    assert f.clients_per_recipient.tolist() == [0, 0, 0, 0] and f.is_new_recipient.sum() == 0
    assert f.component_clients.tolist() == [1, 1, 1, 1]


def test_ring_on_one_device(spark):
    f = features(spark, [{"client_id": f"C{i}", "ip": f"1.1.1.{i}", "timestamp": f"2025-09-10 14:0{i}:00"} for i in range(5)])
    assert f.clients_per_device.tolist() == [1, 1, 2, 3, 4] and f.device_clients_24h.tolist() == [1, 1, 2, 3, 4]


def test_recipient_week_is_wider_than_day(spark):
    rows = [{"client_id": f"C{i}", "device_id": f"D{i}", "ip": f"i{i}", "tx_type": "transfer", "recipient_id": "R1",
             "timestamp": f"2025-09-1{i} 12:00:00"} for i in range(5)]
    f = features(spark, rows)
    assert f.recipient_clients_24h.tolist() == [0, 1, 1, 1, 1] and f.recipient_clients_7d.tolist() == [0, 1, 2, 3, 4]
    assert f.recipient_age_days.tolist() == [0, 1, 2, 3, 4] and f.recipient_is_new_to_bank.tolist() == [1, 0, 0, 0, 0]


def test_component_is_transitive(spark):
    # A-D1-B, B-ip-C, C-R-E: all four clients end in one component
    rows = [{"client_id": "A", "device_id": "D1", "ip": "i1"}, {"client_id": "B", "device_id": "D1", "ip": "i2"},
            {"client_id": "C", "device_id": "D3", "ip": "i2", "recipient_id": "R"},
            {"client_id": "E", "device_id": "D4", "ip": "i4", "recipient_id": "R"}, {"client_id": "A", "device_id": "D1", "ip": "i1"}]
    rows = [{**r, "timestamp": f"2025-09-10 14:0{i}:00"} for i, r in enumerate(rows)]
    f = features(spark, rows)
    assert f.component_clients.tolist() == [1, 1, 1, 1, 4] and f.component_size.iloc[-1] == 11


def test_unknown_codes_and_places(spark):
    f = features(spark, [{"channel": "fax", "tx_type": "gift", "merchant_category": "moon", "city": "Nowhere", "country": "XX"}]).iloc[0]
    assert f.channel_code == 0 and f.tx_type_code == 0 and f.category_risk == 0.3 and f.is_foreign == 1
    assert 900 < f.distance_from_home_km < 1000


def test_impossible_travel(spark):
    f = features(spark, [{}, {"timestamp": "2025-09-10 14:20:00", "city": "Лондон", "country": "GB"}])
    assert f.travel_speed_kmh.iloc[1] > 10000 and f.distance_from_prev_km.iloc[1] > 5000


def replayed(pdf):
    """Component sizes by direct union of sets, row by row."""
    group, out = {}, {}
    for r in pdf.sort_values(["us", "tx_id"]).itertuples():
        c = ("c", r.client_id)
        mine = group.setdefault(c, {c})
        out[r.tx_id] = (sum(k == "c" for k, _ in mine), len(mine))
        for k in ("device_id", "ip", "recipient_id"):
            if getattr(r, k):
                other = group.setdefault((k, getattr(r, k)), {(k, getattr(r, k))})
                if other is not mine:
                    mine = mine | other
                    for x in mine:
                        group[x] = mine
    return out


@pytest.mark.parametrize("span", [500_000, 90])
def test_components_match_replay(spark, span):
    tx = normalise(X.tx_orders(spark, "/root/testdata/sf0.001"))
    want = replayed(tx.select("us", "tx_id", "client_id", "device_id", "ip", "recipient_id").toPandas())
    got = component_features(tx, span).toPandas()
    assert len(got) == len(want)
    assert all(want[r.tx_id] == (r.component_clients, r.component_size) for r in got.itertuples())


def test_one_client_device_and_recipient_with_a_third_of_all_rows(spark):
    """Only the large keys are cut, and nothing changes for anyone."""
    sf = "/root/testdata/sf0.001"
    third = F.col("tx_id") % 3 == 0
    tx = X.tx_events(spark, sf).withColumns({
        "client_id": F.when(third, F.lit(7).cast("long")).otherwise(F.col("client_id")),
        "device_id": F.when(third, "D5").otherwise(F.col("device_id")),
        "recipient_id": F.when(F.col("tx_id") % 5 < 2, "R1").otherwise(F.col("recipient_id"))})
    got = []
    for rows in ("100000000", "40"):
        spark.conf.set("spark.riskloom.chunkRows", rows)
        hot = hot_clients(tx)
        assert (hot.table is None) == (rows != "40")
        d = feature_frame(tx, X.profiles(spark, sf), X.places(spark, sf), components=False)
        got.append(d.select("tx_id", *[f for f in FEATURES if not f.startswith("component")]).toPandas().set_index("tx_id").sort_index())
    spark.conf.unset("spark.riskloom.chunkRows")
    assert 7 in [r.client_id for r in hot.table.collect()]
    pd.testing.assert_frame_equal(got[0], got[1], check_dtype=False)


def test_places_are_not_exchanged_by_city(spark, capsys):
    """The built-in places are broadcast, whatever one city holds of the rows."""
    from riskloom.sources import schema, transactions

    df = spark.range(10).selectExpr("id", "concat('Almaty', id % 2) AS city")
    transactions.with_place(df, schema.places(spark)).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning(city" not in plan
