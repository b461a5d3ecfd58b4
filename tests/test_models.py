import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import anomaly, counterfactual, explain, models
from riskloom.operators import cost
from riskloom.sources.schema import ACTIONS, ANOMALY_FEATURES, FEATURES, SCHEMES


@pytest.fixture(scope="module")
def table(spark):
    """Random features where two of them drive fraud."""
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame(rng.normal(size=(n, len(FEATURES))), columns=FEATURES)
    risk = 1 / (1 + np.exp(-(2.0 * pdf["amount_z"] + 2.0 * pdf["remote_access"] - 3)))
    pdf["is_fraud"] = (rng.random(n) < risk).astype(int)
    pdf["fraud_type"] = np.where(pdf["is_fraud"] == 1, np.array(SCHEMES)[rng.integers(0, 3, n)], "")
    pdf["tx_id"], pdf["amount"], pdf["tx_type"] = np.arange(n), 50000.0, "transfer"
    pdf["split"] = np.where(pdf.tx_id < 1800, "train", np.where(pdf.tx_id < 2250, "valid", "test"))
    return spark.createDataFrame(pdf).repartition(4).cache()


@pytest.fixture(scope="module")
def model(table):
    return models.fit(table, models.Config(rounds=8, step=0.3, depth=3, type_trees=5, anomaly_trees=10, anomaly_sample=256))


def test_chain(table, model):
    d = model.decide(table.where("split = 'test'")).toPandas()
    assert len(d) == 750
    for c in ("p_raw", "p_supervised", "p_anomaly", "p_fraud"):
        assert d[c].between(0, 1).all()
    assert d.p_anomaly.max() <= anomaly.DEFAULT_CAP
    assert np.allclose(d[[f"p_{s}" for s in SCHEMES]].sum(axis=1), 1)
    # calibration keeps the order of scores
    o = d.sort_values("p_raw")
    assert (o.p_supervised.diff().dropna() >= -1e-12).all()
    assert d.loc[d.is_fraud == 1, "p_fraud"].mean() > 2 * d.loc[d.is_fraud == 0, "p_fraud"].mean()


def test_noisy_or_never_lowers(spark):
    d = spark.createDataFrame([(p / 10, a / 10) for p in range(11) for a in range(11)], "p double, a double")
    got = d.withColumn("f", anomaly.noisy_or(F.col("p"), F.col("a"))).toPandas()
    assert (got.f >= got[["p", "a"]].max(axis=1) - 1e-12).all() and got.f.between(0, 1).all()


def test_storage_round_trip(spark, table, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = models.RiskModel.load(spark, str(tmp_path / "m"))
    test = table.where("split = 'test'")
    a = model.decide(test).select("tx_id", "p_fraud", "action").toPandas().set_index("tx_id")
    b = again.decide(test).select("tx_id", "p_fraud", "action").toPandas().set_index("tx_id").loc[a.index]
    assert (a.p_fraud - b.p_fraud).abs().max() < 1e-12 and (a.action == b.action).all()


def test_forest_is_reproducible_and_finds_outliers(spark, table):
    train = table.where("split = 'train'")
    a, b = (anomaly.fit_forest(d, 10, 256, 3) for d in (train, train.repartition(9)))
    pd.testing.assert_frame_equal(a.nodes.sort_values(["tree", "node"]).reset_index(drop=True),
                                  b.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    far = train.limit(5).withColumns({f: F.lit(9.0) for f in ANOMALY_FEATURES})
    normal = a.score(train, "s").agg(F.avg("s")).first()[0]
    assert a.score(far, "s").agg(F.min("s")).first()[0] > normal + 0.1


def test_contributions_add_up_to_log_odds(table, model):
    d = explain.contributions(model.score(table.where("split = 'test'")), model.fraud).select("p_raw", "contributions", "base_value").toPandas()
    total = d.contributions.map(sum) + d.base_value
    assert np.allclose(total, np.log(d.p_raw / (1 - d.p_raw)), atol=1e-9)


def test_contributions_match_enumeration(spark):
    """Against the definition of the Shapley value on a small tree."""
    nodes = pd.DataFrame([
        (0, 0, 0.0, 100, 1, 2, 0, 0.5), (0, 1, 0.0, 60, 3, 4, 1, 1.0), (0, 2, 4.0, 40, -1, -1, -1, None),
        (0, 3, 1.0, 15, -1, -1, -1, None), (0, 4, -2.0, 45, -1, -1, -1, None)],
        columns=["treeID", "id", "prediction", "rawCount", "leftChild", "rightChild", "featureIndex", "cut"])
    leaves, base = explain._leaf_tables(nodes, [1.0])

    def value(known, x):
        left1 = x[1] <= 1.0
        inner = (1.0 if left1 else -2.0) if 1 in known else (15 * 1.0 + 45 * -2.0) / 60
        return 2 * ((inner if x[0] <= 0.5 else 4.0) if 0 in known else (60 * inner + 40 * 4.0) / 100)

    assert base == pytest.approx(value(set(), (0, 0)))
    for x in itertools.product([0.0, 1.0], [0.5, 2.0]):
        phi = np.zeros(2)
        for fs, lo, hi, table in leaves:
            phi[fs] += table[int(((np.array(x)[fs] > lo) & (np.array(x)[fs] <= hi)) @ (1 << np.arange(len(fs))))]
        want = [sum(math.factorial(len(s)) * math.factorial(1 - len(s)) / 2 * (value(set(s) | {i}, x) - value(set(s), x))
                    for s in [(), (1 - i,)]) for i in (0, 1)]
        assert np.allclose(phi, want)


# ---------------------------------------------------------------- counterfactuals

def stub(limits):
    """A scorer whose action depends on the amount alone."""
    def score(d):
        out = F.lit(limits[-1][1])
        for limit, action in reversed(limits[:-1]):
            out = F.when(F.col("amount") <= limit, action).otherwise(out)
        return d.withColumns({"action": out, "p_fraud": F.lit(0.5)})
    return score


def case(spark, amount=1_000_000.0, action="hold", **kw):
    row = dict(tx_id=1, amount=amount, action=action, p_fraud=0.5, is_vpn=0.0, remote_access=0.0, call_minutes_before=0.0,
               device_id="D1", city="A", country="KZ", usual_device="D1", device_known=True, home_city="A", home_country="KZ")
    return spark.createDataFrame(pd.DataFrame([{**row, **kw}]))


def test_boundary_far_below_one_percent(spark):
    r = counterfactual.find_counterfactuals(case(spark), stub([(500, "allow"), (1e9, "hold")])).first()
    assert r.field == "amount" and r.action_to == "allow" and float(r.becomes) == 400.0
    assert r.text == "Had the amount stayed under 400 KZT, the decision would differ"


def test_boundary_is_tight(spark):
    r = counterfactual.find_counterfactuals(case(spark), stub([(87_350, "step_up"), (1e9, "hold")])).first()
    assert float(r.becomes) == 87_300.0 and r.action_to == "step_up"


def test_nothing_helps_and_already_softest(spark):
    r = counterfactual.find_counterfactuals(case(spark), stub([(1, "allow"), (1e9, "hold")])).first()
    assert r.note == "nothing_helps" and r.field is None
    r = counterfactual.find_counterfactuals(case(spark, action="allow"), stub([(1e9, "allow")])).first()
    assert r.note == "already_softest"


def test_flips_are_softer_and_city_brings_its_country(spark):
    def score(d):
        bad = F.when(F.col("country") != "KZ", 2).otherwise(0) + F.when(F.col("is_vpn") == 1, 1).otherwise(0)
        return d.withColumns({"action": F.get(F.lit(ACTIONS), bad), "p_fraud": bad / 10.0})

    d = case(spark, action="block", is_vpn=1.0, city="B", country="TR", device_id="D9", device_known=False)
    got = {r.field: r for r in counterfactual.flips(d, score).collect()}
    assert set(got) == {"is_vpn", "city"}
    assert got["city"].action_to == "step_up" and got["city"].becomes == "A" and got["is_vpn"].action_to == "hold"
    best = counterfactual.find_counterfactuals(d, score).where("rank = 1").first()
    assert best.field == "city"


def test_messages(spark):
    d = spark.createDataFrame([("allow", "social_eng", 1e6), ("hold", "social_eng", 1e6), ("hold", "fraud_ring", 1234567.0)],
                              "action string, dominant_kind string, amount double")
    got = d.select(explain.client_message("en").alias("m"), explain.operator_script("en").alias("s")).collect()
    assert got[0].m == "" and got[0].s == ""
    assert "Hang up" in got[1].m and got[1].s.startswith("Ask directly")
    assert "1 234 567 KZT" in got[2].m and "group" in got[2].s


def test_generic_phrase(spark):
    d = spark.createDataFrame([(1, "mystery", "risk", "x", "y", "z", "A", 1.0)],
                              "tx_id int, feature string, direction string, merchant_category string, channel string, tx_type string, city string, amount double")
    assert explain.reason_text(d, "en", features=[]).first().text == "Atypical value of feature “mystery”"
    assert explain.reason_text(d, "ru", features=[]).first().text == "Нетипичное значение признака «mystery»"


def test_realised_cost_of_columns(spark):
    d = spark.createDataFrame([("hold", 1, "social_eng", 1000.0, "transfer")], "a string, is_fraud int, fraud_type string, amount double, tx_type string")
    want = (1 - 0.8) * (1000 * 0.92 + 5000) + 1500
    assert d.select(cost.realised_cost(F.col("a"), avg=None, count=None)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("rows", [50, 63, 64, 65, 3000])
def test_tree_samples_follow_one_rule(spark, rows):
    """Every tree gets exactly its sample from tables smaller and larger than it, and reruns draw the same rows."""
    from riskloom.operators import anomaly

    df = spark.range(rows).select(F.col("id").alias("tx_id"), *[F.col("id").cast("double").alias(c) for c in anomaly.ANOMALY_FEATURES])
    drawn, size = anomaly.tree_samples(df, 5, 64, 1)
    got = sorted((r.tree, r.tx_id) for r in drawn.select("tree", "tx_id").collect())
    assert size == min(64, rows) and [sum(t == k for t, _ in got) for k in range(5)] == [size] * 5
    again, _ = anomaly.tree_samples(df.repartition(3), 5, 64, 1)
    assert got == sorted((r.tree, r.tx_id) for r in again.select("tree", "tx_id").collect())
