import numpy as np
import pandas as pd
import pytest

from riskloom.operators import components


def many_links(spark, clients=400, entities=12, seed=5):
    """Every client uses every entity once, at random moments; many moments are equal."""
    rng = np.random.default_rng(seed)
    u, v = (x.ravel() for x in np.meshgrid(np.arange(clients), 10_000 + np.arange(entities), indexing="ij"))
    pdf = pd.DataFrame({"u": u, "v": v, "us": rng.integers(0, 900, len(u)), "tx_id": rng.permutation(len(u)), "part": rng.integers(0, 3, len(u))})
    return spark.createDataFrame(pdf, "u long, v long, us long, tx_id long, part int").repartition(5)


def replayed_log(links):
    pdf = links.toPandas().assign(uc=1, un=1, vc=0, vn=1)
    return sorted(components._replay((0,), pdf).itertuples(index=False, name=None))


def test_links_that_merge_nothing_are_not_contracted(spark, monkeypatch):
    """4800 links, 411 merges: what is left fits into one short span, so no level of halves is needed; a level relabelled all later links."""
    links, calls = many_links(spark), []
    labels = components.min_labels
    monkeypatch.setattr(components, "min_labels", lambda e: calls.append(1) or labels(e))
    got = sorted(map(tuple, components.merges(links, 1500).collect()))
    assert got == replayed_log(links) and len(got) == 411 and not calls


@pytest.mark.parametrize("most", [7, 100, 1500])
def test_thinned_links_merge_the_same(spark, most):
    """Bounded runs of any size, one client with more links than a run, nodes that stand for several."""
    one = many_links(spark, 1, 300, 6).selectExpr("u + 999 AS u", "v", "us", "tx_id + 10000 AS tx_id", "part")
    links = many_links(spark, 60).unionByName(one).selectExpr("*", "2 AS uc", "3 AS un", "0 AS vc", "4 AS vn")
    left = components.thinned(links, most)
    assert left.schema.names == links.schema.names and left.exceptAll(links).isEmpty()
    full, thin = (sorted(components._replay((0,), d.toPandas()).itertuples(index=False, name=None)) for d in (links, left))
    assert full == thin
    assert most < 1500 or left.count() < links.count()
