import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import selection
from riskloom.operators import drift, metrics
from riskloom.sources.schema import FEATURES


@pytest.fixture(scope="module")
def numbers(spark):
    """Ties, signs, wide ranges, constants, nulls, NaN and infinities."""
    rng = np.random.default_rng(2)
    n = 4000
    pdf = pd.DataFrame({
        "id": rng.permutation(n), "wide": np.exp(rng.normal(0, 40, n)) * rng.choice([-1, 1], n), "ties": rng.integers(0, 4, n).astype(float), "same": np.full(n, 7.25),
        "zero": np.where(rng.random(n) < 0.9, rng.choice([0.0, -0.0], n), rng.normal(size=n)), "ends": np.where(rng.random(n) < 0.01, np.inf, rng.random(n)),
        "big": rng.integers(-(1 << 62), 1 << 62, n), "near": (1 << 60) + rng.integers(0, 5, n), "name": [f"r{i:05d}" for i in rng.permutation(n)]})
    df = spark.createDataFrame(pdf).withColumns({"none": F.lit(None).cast("double"), "gaps": F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, float("nan")).otherwise(F.col("wide"))})
    return pdf, selection.narrow(df.repartition(6), "*")


@pytest.mark.parametrize("cells", [selection.CELLS, 16])
def test_values_at(numbers, cells, monkeypatch):
    """All columns in the same passes, with many and with few cells a pass."""
    monkeypatch.setattr(selection, "CELLS", cells)
    pdf, df = numbers
    asked = [0, 1, 17, 1999, 2000, 3999, 4000, -1]
    names = ["wide", "ties", "same", "zero", "ends", "big", "near", "id"]
    found = selection.values_at(df, {c: F.col(c) for c in names + ["none", "gaps"]}, lambda name, n: asked)
    for c in names:
        v = np.sort(pdf[c].to_numpy())
        n, at = found[c]
        assert n == 4000 and sorted(at) == asked[:6]
        for r, f in at.items():
            assert f.value == v[r] and f.below == (v < v[r]).sum() and f.equal == (v == v[r]).sum()
    assert found["none"] == (0, {})
    kept = np.sort(pdf.loc[pdf["id"] % 3 == 2, "wide"].to_numpy())
    assert found["gaps"][0] == len(kept) and found["gaps"][1][17].value == kept[17]


def test_quantiles_of(numbers):
    pdf, df = numbers
    probs = [0.0, 0.1, 0.37, 0.5, 0.93, 1.0]
    got = selection.quantiles_of(df, {c: F.col(c) for c in ("wide", "ties", "same", "zero", "none")}, probs)
    for c in ("wide", "ties", "same", "zero"):
        assert np.allclose(got[c], np.quantile(pdf[c], probs), rtol=1e-12)
    assert got["none"] == []


@pytest.mark.parametrize("order", [["ties", "id"], ["near", "name"], ["same", "ties", "big"], ["wide", "id"]])
def test_rows_at(numbers, order):
    pdf, df = numbers
    want = pdf.sort_values(order)[order].to_numpy()
    n, got = selection.rows_at(df, order, lambda n: {"first": 0, "some": 1234, "next": 1235, "last": n - 1, "past": n})
    assert n == 4000 and got.pop("past") is None
    for name, r in (("first", 0), ("some", 1234), ("next", 1235), ("last", 3999)):
        assert list(got[name]) == list(want[r])


def test_rows_at_of_nothing(numbers):
    _, df = numbers
    assert selection.rows_at(df.limit(0), ["ties", "id"], lambda n: {"first": 0}) == (0, {"first": None})


def test_one_stray_time_does_not_bring_back_a_full_ranking(spark, monkeypatch):
    """A value far from all others leaves the rest to be told apart; only ties are ranked."""
    ranked = []
    plain = selection.scan.global_index
    monkeypatch.setattr(selection.scan, "global_index", lambda df, *a, **k: (ranked.append(df.count()), plain(df, *a, **k))[1])
    d = spark.range(20_000).select(F.col("id").alias("tx_id"), F.when(F.col("id") == 5, F.lit(1 << 61)).otherwise(F.col("id") * 7 + 1_700_000_000_000_000).alias("us"))
    split = metrics.time_split(d).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 12_000, "valid": 3_000, "test": 5_000}
    assert sum(ranked) == 0


def test_recalls_at_budget(spark):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"tx_id": rng.permutation(n), "p": np.round(rng.random(n), 2), "kind": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    for budget in (0.0001, 0.0215, 0.5, 1.0):
        k = max(1, round(n * budget))
        top = set(pdf.sort_values(["p", "tx_id"], ascending=[False, True])["tx_id"][:k])
        got = {r["name"]: (r["recall"], r["n"]) for r in metrics.recalls_at_budget(df, {str(i): F.col("kind") == i for i in range(4)}, "p", budget).collect()}
        for i in range(3):
            own = pdf.loc[pdf["kind"] == i, "tx_id"]
            assert got[str(i)] == (pytest.approx(own.isin(top).mean()), len(own))
        assert got["3"] == (None, 0)
    one = metrics.recall_at_budget(df, F.col("kind") == 1, "p", 0.5).first()
    assert one["n"] == (pdf["kind"] == 1).sum()
    assert metrics.recall_at_budget(df.limit(0), F.col("kind") == 1, "p").first()["n"] == 0


def psi_plainly(reference, current, bins=10):
    edges = list(dict.fromkeys(np.quantile(reference, [i / bins for i in range(bins + 1)])))
    if len(edges) < 3:
        return 0.0
    e, a = (np.bincount(np.searchsorted(edges[1:-1], x, side="right"), minlength=len(edges) - 1) / len(x) for x in (reference, current))
    seen = (e + a) > 0
    e, a = np.maximum(e, 1e-4), np.maximum(a, 1e-4)
    return float(((a - e) * np.log(a / e))[seen].sum())


def test_psi_of_all_features_without_a_row_shuffle(spark):
    rng = np.random.default_rng(6)
    n = 2500
    data = {f: rng.normal(i % 4 * 0.2, 1 + i % 3, n) if i % 2 else rng.integers(0, 1 + i, n).astype(float) for i, f in enumerate(FEATURES)}
    side = np.where(np.arange(n) < 1300, "reference", "current")
    for i, f in enumerate(FEATURES):
        data[f][side == "current"] += 0.3 * (i % 5)
    df = spark.createDataFrame(pd.DataFrame(data | {"side": side})).repartition(5)
    found = drift.psi(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "NestedLoop" not in plan
    got = {r["feature"]: r["psi"] for r in found.collect()}
    assert set(got) == set(FEATURES)
    for f in FEATURES:
        assert got[f] == pytest.approx(psi_plainly(data[f][side == "reference"], data[f][side == "current"]), abs=1e-9)


def test_psi_without_a_side_or_values(spark):
    rows = [("reference", float(i), None) for i in range(30)]
    got = {r["feature"]: r["psi"] for r in drift.psi(spark.createDataFrame(rows, "side string, x double, y double"), ["x", "y"]).collect()}
    assert got == {"x": 0.0, "y": 0.0}


def test_recalls_of_many_scores(spark):
    """Every score's cut at once gives what each gives alone, ties, missing scores and constant scores included."""
    rng = np.random.default_rng(9)
    n = 2000
    pdf = pd.DataFrame({"tx_id": rng.permutation(n), "a": np.round(rng.random(n), 1), "b": rng.random(n), "c": np.full(n, 0.3), "kind": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf).withColumns({"gaps": F.when(F.col("tx_id") % 2 == 0, F.col("b")), "none": F.lit(None).cast("double")})
    masks = {str(i): F.col("kind") == i for i in range(4)}
    for budget in (0.0001, 0.1, 0.7, 1.0):
        got = {(r["score"], r["name"]): (r["recall"], r["n"]) for r in metrics.recalls_of_scores(df, {c: F.col(c) for c in ("a", "b", "c", "gaps", "none")}, masks, budget).collect()}
        for c in ("a", "b", "c", "gaps", "none"):
            alone = {r["name"]: (r["recall"], r["n"]) for r in metrics.recalls_at_budget(df, masks, c, budget).collect()}
            assert {name: got[c, name] for name in masks} == alone
