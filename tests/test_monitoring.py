import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift, metrics
from riskloom.sources.transactions import read_profiles, read_transactions


def psi(spark, ref, cur):
    pdf = pd.concat([pd.DataFrame({"side": "reference", "x": ref}), pd.DataFrame({"side": "current", "x": cur})])
    return drift.psi(spark.createDataFrame(pdf), ["x"]).first()


def direct_psi(ref, cur):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    e = np.clip(np.histogram(ref, edges)[0] / len(ref), 1e-4, None)
    a = np.clip(np.histogram(cur, edges)[0] / len(cur), 1e-4, None)
    return float(((a - e) * np.log(a / e)).sum())


def test_psi(spark):
    rng = np.random.default_rng(3)
    ref = rng.normal(size=2000)
    for cur in (rng.normal(size=1500), rng.normal(1.5, 1, 1500), np.full(1500, 0.2)):
        got = psi(spark, ref, cur)
        assert got.psi == pytest.approx(direct_psi(ref, cur), abs=1e-9)
    assert psi(spark, ref, rng.normal(size=1500)).verdict == "stable"
    assert psi(spark, ref, rng.normal(1.5, 1, 1500)).verdict == "significant"


def test_constant_feature_has_no_drift(spark):
    assert psi(spark, np.zeros(500), np.ones(500)).psi == 0.0


def test_gate(spark):
    rows = spark.createDataFrame([("a", 0.4, "significant", False), ("b", 0.9, "significant", True), ("c", 0.01, "stable", False)],
                                 "feature string, psi double, verdict string, accumulating boolean")
    good = spark.createDataFrame([("w", 0.001)], "period string, gap double")
    bad = spark.createDataFrame([("w", -0.02), ("v", 0.01)], "period string, gap double")
    g = drift.gate(rows, good).first()
    assert (g.verdict, g.shifted, g.calibration_broken) == ("retrain", "a", False)
    assert drift.gate(rows.where("accumulating"), good).first().ok
    g = drift.gate(rows.where("feature = 'c'"), bad)
    assert g.first().worst_gap == 0.02
    assert [r.kind for r in drift.gate_reasons(g).collect()] == ["calibration"]


def test_ranking_metrics_match_direct_computation(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(800) < 0.1).astype(int)
    p = np.round(np.clip(y * 0.3 + rng.random(800) * 0.7, 0, 1), 2)
    df = spark.createDataFrame(pd.DataFrame({"tx_id": range(800), "p_fraud": p, "is_fraud": y}))
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ts = np.unique(p)[::-1]
    prec, rec = np.array([y[p >= t].mean() for t in ts]), np.array([y[p >= t].sum() / y.sum() for t in ts])
    assert metrics.average_precision(df).first()[0] == pytest.approx((np.diff(rec, prepend=0) * prec).sum())
    got = metrics.recall_at_precision(df, [0.5]).first()
    ok = prec >= 0.5
    assert got.recall == pytest.approx(rec[ok].max()) and got.threshold == ts[ok & (rec == rec[ok].max())].min()
    none = metrics.recall_at_precision(df.withColumn("is_fraud", F.lit(0)), [0.9]).first()
    assert (none.recall, none.threshold) == (0.0, 1.0)


def test_spread_ignores_missing(spark):
    d = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", float("nan")), ("m", 8.0)], "k string, v double")
    assert tuple(metrics.spread(d, ["k"], "v").first()) == ("m", 3.0, 1.0, 8.0, 3)


def test_csv_with_mixed_times(spark, tmp_path):
    f = tmp_path / "tx.csv"
    f.write_text("tx_id,timestamp,client_id,amount,recipient_id\nA,2025-09-01 10:00:00,C1,5.5,\nB,2025-09-01T11:00:00,C1,7,R1\n"
                 "C,soon,C2,1,\nD,2025-09-02,C2,3,\n")
    from pyspark.sql import Observation

    seen = Observation()
    d = read_transactions(spark, str(f), seen)
    assert sorted(r.tx_id for r in d.collect()) == ["A", "B", "D"]
    assert seen.get["rejected"] == 1
    assert dict(d.dtypes)["timestamp"] == "timestamp" and dict(d.dtypes)["amount"] == "double"
    p = tmp_path / "cl.csv"
    p.write_text("client_id,age,home_city,avg_ticket,tenure_days,vpn_user\nC1,40,Алматы,5000,100,0\n")
    assert read_profiles(spark, str(p)).first().age == 40
