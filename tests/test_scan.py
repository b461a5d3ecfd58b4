import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import scan
from riskloom.functions.quantiles import quantiles


@pytest.fixture
def skewed(spark):
    """A third of all rows on one key, many equal times."""
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.34, "hot", [f"k{i}" for i in rng.integers(0, 300, n)])
    pdf = pd.DataFrame({"key": key, "t": rng.integers(0, 400, n), "id": np.arange(n), "x": rng.integers(0, 100, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(7)
    return pdf, df


def expected(pdf):
    p = pdf.sort_values(["key", "t", "id"])
    g = p.groupby("key")["x"]
    out = p[["id"]].copy()
    out["s"] = g.transform(lambda v: v.fillna(0).cumsum().shift(fill_value=0))
    out["lo"] = g.transform(lambda v: v.cummin().ffill().shift())
    out["hi"] = g.transform(lambda v: v.cummax().ffill().shift())
    out["last"] = g.transform(lambda v: v.ffill().shift())
    return out.set_index("id").sort_index()


@pytest.mark.parametrize("rows", [10_000_000, 50, 5])
def test_running_is_the_same_for_any_chunk_size(skewed, rows):
    pdf, df = skewed
    hot = scan.find_hot(df, ["key"], ["t", "id"], rows)
    assert (hot.table is None) == (rows == 10_000_000)
    r = scan.running(df, ["key"], ["t", "id"], sums={"s": "x"}, mins={"lo": "x"}, maxs={"hi": "x"}, lasts={"last": "x"}, hot=hot)
    got = r.select("id", "s", "lo", "hi", "last").toPandas().set_index("id").sort_index()
    pd.testing.assert_frame_equal(got, expected(pdf), check_dtype=False)


def test_hot_key_is_spread_over_chunks(skewed):
    _, df = skewed
    hot = scan.find_hot(df, ["key"], ["t", "id"], 50)
    sizes = scan.chunked(df, hot, ["t", "id"]).groupBy("key", "_chunk").count().where("key = 'hot'").toPandas()["count"]
    assert len(sizes) > 8 and sizes.max() < 400 and sizes.sum() > 900
    # nearly all of the 300 keys of ten rows are left alone
    assert hot.table.count() <= 5


def test_global_index(skewed):
    pdf, df = skewed
    got = scan.global_index(df, ["t", "id"], rows=100).toPandas().sort_values("row_index")
    want = pdf.sort_values(["t", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["row_index"].tolist() == list(range(len(pdf)))


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.37, 0.5, 0.93, 1.0]
    q = quantiles(df.where("x IS NOT NULL"), ["key"], "x", probs).toPandas().set_index("key")["q"]
    for key, part in pdf.dropna().groupby("key"):
        assert np.allclose(q[key], np.quantile(part["x"], probs), atol=1e-9)
