"""Every query with a SQL counterpart gives the same rows in both engines."""

import pytest

import __spark_entry__ as E
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF) is None


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["tx_id", "action", "chosen_cost", "runner_up", "margin_to_next", "saving_vs_allow"]
    assert df.count() == 1000


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["f_velocity", "f_device", "f_net_window", "f_net_window_ties", "client_usage",
                                  "event_order", "roc_auc", "capacity_curve", "psi", "replay_sequence"])
def test_large_key_path_matches_sql(spark, con, small_chunks, name):
    """The same results when nearly every key counts as large."""
    assert compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF) is None
