"""The full point-in-time feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskloom.functions.storage import stored
from riskloom.operators.client_features import client_features, client_state
from riskloom.operators.components import component_features
from riskloom.operators.entity_features import with_entity_features
from riskloom.sources.schema import FEATURES
from riskloom.sources.transactions import normalise


def feature_frame(tx: DataFrame, profiles: DataFrame, places: DataFrame, network: bool = True,
                  components: bool = True) -> DataFrame:
    """The transactions with their features; the network and graph parts can be left out."""
    state = client_state(tx, profiles, places)
    if network:
        state = stored(state, "client-state")  # the network pass reads it too
    d = client_features(state)
    if network:
        d = with_entity_features(d, tx, state)
    if components:
        d = d.join(component_features(normalise(tx)), "tx_id")
    return d


def feature_matrix(tx: DataFrame, profiles: DataFrame, places: DataFrame,
                   keep: list[str] | None = None) -> DataFrame:
    """tx_id, the columns to keep and all features in model order, as doubles."""
    d = feature_frame(tx, profiles, places)
    return d.select("tx_id", *(keep or []), *[d[f].cast("double").alias(f) for f in FEATURES])
