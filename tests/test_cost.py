import pytest
from pyspark.sql import functions as F

from riskloom.functions.economics import Economics
from riskloom.operators import cost, policies
from riskloom.sources.schema import ACTIONS

SOCIAL = (0.04, 0.92, 0.04)
STOLEN = (0.92, 0.04, 0.04)


def frame(spark, rows):
    cols = "p_fraud double, amount double, tx_type string, p_stolen_card double, p_social_eng double, p_fraud_ring double"
    return spark.createDataFrame([(float(p), float(a), t, *k) for p, a, t, k in rows], cols)


def decided(spark, rows, econ=cost.DEFAULT):
    return cost.decide(frame(spark, rows), econ, avg=None, count=None).toPandas()


def test_chosen_is_the_cheapest(spark):
    d = decided(spark, [(p / 20, a, t, k) for p in range(21) for a in (900, 40000, 3000000) for t in ("transfer", "purchase") for k in (SOCIAL, STOLEN)])
    costs = d[[f"cost_{a}" for a in ACTIONS]]
    assert (d.chosen_cost == costs.min(axis=1)).all() and (d.margin_to_next >= 0).all() and (d.saving_vs_allow >= 0).all()
    assert (d.action != d.runner_up).all()


def test_allowing_costs_more_with_probability(spark):
    d = decided(spark, [(p / 10, 50000, "transfer", SOCIAL) for p in range(11)])
    assert d.cost_allow.is_monotonic_increasing and d.cost_allow.iloc[0] == 0


def test_a_call_beats_a_push_against_persuasion(spark):
    d = decided(spark, [(0.6, 500000, "transfer", SOCIAL), (0.6, 500000, "transfer", STOLEN)])
    assert d.action.iloc[0] == "hold"
    assert d.cost_step_up.iloc[1] < d.cost_step_up.iloc[0]


def test_no_fraud_means_allow_and_threshold_moves_with_amount(spark):
    d = decided(spark, [(0.0, 10 ** 6, "purchase", STOLEN), (0.005, 3000, "transfer", STOLEN), (0.005, 3000000, "transfer", STOLEN)])
    assert d.action.tolist()[:2] == ["allow", "allow"]
    assert ACTIONS.index(d.action.iloc[2]) > 0


def test_ties_go_to_the_milder_action(spark):
    e = Economics(step_up_op_cost=0, step_up_annoyance=0, step_up_friction_rate=0, step_up_abandon_rate=0)
    assert decided(spark, [(0.0, 1000, "purchase", STOLEN)], e).action.iloc[0] == "allow"


def test_out_of_range_probability_is_clamped(spark):
    d = decided(spark, [(1.7, 1000, "purchase", STOLEN), (1.0, 1000, "purchase", STOLEN), (-3, 1000, "purchase", STOLEN)])
    assert d.cost_allow.tolist() == [5600.0, 5600.0, 0.0]


def test_unknown_economics_are_ignored():
    assert Economics().override({"nonsense": 1, "hold_op_cost": 9.0}).hold_op_cost == 9.0
    assert Economics().scaled(2).effectiveness["hold"]["stolen_card"] == 0.99


def test_client_value_limits(spark):
    d = spark.createDataFrame([(1000.0, 5000.0, 2.0), (1000.0, 1e6, 900.0), (1000.0, None, None), (1e7, 0.0, 0.0)], "amount double, client_avg double, client_count double")
    got = [r[0] for r in d.select(cost.client_value()).collect()]
    assert got == [25000.0, 1200000.0, 180000.0, 1200000.0]


def test_best_threshold_matches_direct_search(spark):
    rows = [(i % 40 / 40, 1000 + 997 * i % 90000, "transfer", STOLEN) for i in range(400)]
    d = frame(spark, rows).withColumns({"is_fraud": (F.col("p_fraud") > 0.6).cast("int"), "fraud_type": F.lit("stolen_card"),
                                        "client_avg": F.lit(5000.0), "client_count": F.lit(9.0)})
    grid = {r.threshold: r.total_cost for r in policies.threshold_grid(d).collect()}
    for t in (0.05, 0.5, 0.95):
        act = F.when(F.col("p_fraud") >= t, "block").otherwise("allow")
        want = d.withColumn("a", act).agg(F.sum(cost.realised_cost(F.col("a")))).first()[0]
        assert grid[t] == pytest.approx(want)
    assert policies.best_threshold(d).first().threshold == min(grid, key=lambda t: (grid[t], t))


def test_decision_map_gets_stricter(spark):
    d = frame(spark, [(0.1, a, "transfer", SOCIAL) for a in (1000, 5000000)])
    m = policies.decision_map(d, 8, 21).toPandas()
    m["rank"] = m.action.map(ACTIONS.index)
    cells = m[m.kind == "stolen_card"].groupby("i")
    assert cells.ngroups == m.i.nunique() > 1
    for _, g in cells:
        first = g.sort_values("j")["rank"].gt(0).tolist()
        assert first == sorted(first)
