"""Registered queries: every operator over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import phrases, scan
from riskloom.functions.economics import Economics
from riskloom.functions.rounding import half_up
from riskloom.functions.storage import new_path, saved, stored
from riskloom.operators import client_summary as cs
from riskloom.operators import (anomaly, cost, counterfactual, dashboard, drift, experiments, explain, graph,
                                metrics, models, policies, replay)
from riskloom.operators.client_features import client_features, client_state
from riskloom.operators.components import component_features
from riskloom.operators.entity_features import with_entity_features
from riskloom.operators.features import feature_frame, feature_matrix
from riskloom.sources import fixtures as X
from riskloom.sources import schema as S
from riskloom.sources import transactions as TX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 6


def query(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    QUERIES[fn.__name__.removesuffix("_all")] = run
    return run


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits, so engines can be compared."""
    return df.select(*[half_up(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _summary(spark, sf):
    return cs.client_summary(X.tx_events(spark, sf), X.profiles(spark, sf))


def _decided(spark, sf):
    """Scored events with decisions that use end-of-stream client summaries."""
    return dashboard.decided(X.scored_events(spark, sf), _summary(spark, sf))


def _state(spark, sf):
    return client_state(X.tx_events(spark, sf), X.profiles(spark, sf), X.places(spark, sf))


def _client(spark, sf, *names):
    return rounded(client_features(_state(spark, sf)).select("tx_id", *names))


def _network(spark, sf, *names):
    tx = X.tx_events(spark, sf)
    return rounded(with_entity_features(tx.select("tx_id"), tx).select("tx_id", *names))


# ---------------------------------------------------------------- sources and normalisation

@query
def src_transactions(spark, sf):
    """Mixed timestamp spellings; unreadable ones are dropped."""
    e = X.table(spark, sf, "events")
    spelled = (F.when(F.col("event_id") % 17 == 0, "not a time")
               .when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
               .when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd.MM.yyyy HH:mm:ss"))
               .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    d = e.select(F.col("event_id").alias("tx_id"), spelled.alias("timestamp"), F.col("value").alias("amount"))
    d = d.withColumn("timestamp", TX.parse_timestamp("timestamp")).where(F.col("timestamp").isNotNull())
    return d.select("tx_id", F.unix_micros("timestamp").alias("us"), "amount")


@query
def src_profiles(spark, sf):
    """Profiles of all clients of both streams; clients without one get the defaults."""
    who = X.tx_events(spark, sf).select("client_id").unionByName(X.tx_orders(spark, sf).select("client_id")).distinct()
    return TX.with_profile(who, X.profiles(spark, sf)).select("client_id", "age", "home_city", "avg_ticket", "tenure_days")


@query
def geo_lookup(spark, sf):
    t = X.tx_events(spark, sf).select("tx_id", F.when(F.col("city_id") % 5 == 0, "NOWHERE").otherwise(F.col("city")).alias("city"))
    return TX.with_place(t, X.places(spark, sf), country="country").select("tx_id", "city", "lat", "lon", "country")


@query
def norm_fields(spark, sf):
    """Spelled-out missing values and defaults."""
    k = F.col("k")
    t = X.tx_events(spark, sf).withColumns({
        "recipient_id": F.when(k % 5 == 0, "nan").when(k % 5 == 1, "None").when(k % 5 == 2, F.lit(None)).otherwise(F.col("recipient_id")),
        "channel": F.when(k % 4 == 0, "NaT").otherwise(F.col("channel")),
        "call_minutes_before": F.when(k % 6 == 0, "n/a").when(k % 6 == 1, "NaN").otherwise(k.cast("string")),
        "country": F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("country"))})
    return TX.normalise(t).select("tx_id", "us", "recipient_id", "channel", "call_minutes_before", "country", "amount")


@query
def event_order(spark, sf):
    """Position of every transaction in the total order, on the stream with equal timestamps."""
    return scan.global_index(X.tx_orders(spark, sf).select("tx_id", "us"), ["us", "tx_id"])


@query
def scored_table(spark, sf):
    """Scored table written by day and read back."""
    path = new_path(spark, "scored")
    TX.write_by_day(_decided(spark, sf).select("tx_id", "timestamp", "p_fraud", "action", "chosen_cost"), path)
    back = spark.read.parquet(path)
    return rounded(back.select("tx_id", F.col("day").cast("string").alias("day"), "p_fraud", "action", "chosen_cost"))


@query
def report_document(spark, sf):
    """A report written as a document and read back."""
    path = new_path(spark, "report")
    found = rounded(policies.policy_per_type(_split(spark, sf).where("split = 'test'")))
    TX.write_document(found, path)
    return spark.read.schema(found.schema).json(path)


@query
def observed_history(spark, sf):
    """History stored, newer transactions observed, and the features of those computed from what is stored."""
    tx = X.tx_events(spark, sf)
    path = new_path(spark, "history")
    newer = F.col("tx_id") % 5 == 0
    replay.observe(path, tx.where(~newer))
    replay.observe(path, tx.where(newer))
    stored_tx = replay.history(spark, path)
    d = client_features(client_state(stored_tx, X.profiles(spark, sf), X.places(spark, sf)))
    d = with_entity_features(d.where(newer), stored_tx)
    return rounded(d.select("tx_id", "history_len", "tx_count_24h", "device_tx_share", "clients_per_device", "recipient_clients_24h"))


@query
def resolve_defaults(spark, sf):
    """Requests with gaps, filled from what is known; unknown clients drop out."""
    tx = X.tx_events(spark, sf)
    return cs.resolve_defaults(_requests(tx), tx, X.profiles(spark, sf)).select(
        "tx_id", "client_id", "city", "device_id", "ip", "recipient_id")


@query
def rejected_requests(spark, sf):
    tx = X.tx_events(spark, sf)
    return cs.unknown_clients(_requests(tx), tx, X.profiles(spark, sf)).select("tx_id", "client_id")


def _requests(tx):
    i = F.col("tx_id")
    return tx.select(
        "tx_id", F.when(i % 97 == 0, F.col("client_id") + 1000000).otherwise(F.col("client_id")).alias("client_id"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(F.col("timestamp").cast("timestamp")).alias("timestamp"), "tx_type",
        F.when(i % 2 == 0, "").otherwise(F.col("city")).alias("city"),
        F.when(i % 3 == 0, "").otherwise(F.col("device_id")).alias("device_id"),
        F.when(i % 5 == 0, "").otherwise(F.col("ip")).alias("ip"),
        F.when(i % 7 == 0, "").otherwise(F.col("recipient_id")).alias("recipient_id"))


# ---------------------------------------------------------------- features

@query
def f_amount(spark, sf):
    return _client(spark, sf, "log_amount", "amount_to_avg", "amount_z", "amount_to_max", "is_amount_record", "is_round_amount")


@query
def f_time(spark, sf):
    return _client(spark, sf, "hour", "is_night", "is_weekend")


@query
def f_velocity(spark, sf):
    return _client(spark, sf, "hours_since_prev", "tx_count_1h", "tx_count_24h", "amount_24h_to_avg")


@query
def f_device(spark, sf):
    return _client(spark, sf, "is_new_device", "device_tx_share", "device_age_days")


@query
def f_geo(spark, sf):
    return _client(spark, sf, "is_new_city", "city_tx_share", "is_foreign", "distance_from_home_km",
                   "distance_from_prev_km", "travel_speed_kmh")


@query
def f_session(spark, sf):
    return _client(spark, sf, "is_vpn", "remote_access", "call_minutes_before", "has_long_call", "session_duration_s")


@query
def f_category(spark, sf):
    return _client(spark, sf, "category_risk", "is_new_category", "channel_code", "tx_type_code", "is_transfer")


@query
def f_client(spark, sf):
    return _client(spark, sf, "client_age", "client_tenure_days", "history_len", "night_share", "own_context")


@query
def f_net_total(spark, sf):
    return _network(spark, sf, "clients_per_device", "clients_per_ip", "clients_per_recipient")


@query
def f_recipient(spark, sf):
    d = with_entity_features(client_features(_state(spark, sf)), X.tx_events(spark, sf))
    return rounded(d.select("tx_id", "is_new_recipient", "recipient_age_days", "recipient_is_new_to_bank"))


NET_WINDOW = ["recipient_clients_24h", "recipient_clients_7d", "recipient_inbound_24h", "recipient_amount_24h",
              "device_clients_24h", "ip_clients_24h"]


@query
def f_net_window(spark, sf):
    return _network(spark, sf, *NET_WINDOW)


@query
def f_net_window_ties(spark, sf):
    """The same counters on a stream where many transactions share a timestamp."""
    tx = X.tx_orders(spark, sf)
    st = client_state(tx, X.profiles(spark, sf), X.places(spark, sf))
    return rounded(with_entity_features(client_features(st), tx).select("tx_id", "tx_count_24h", "clients_per_device", *NET_WINDOW))


@query
def graph_component(spark, sf):
    return component_features(TX.normalise(X.tx_events(spark, sf)))


@query
def feature_matrix_all(spark, sf):
    return rounded(feature_matrix(X.tx_events(spark, sf), X.profiles(spark, sf), X.places(spark, sf)))


# ---------------------------------------------------------------- state summaries

@query
def client_summary(spark, sf):
    return rounded(_summary(spark, sf), 3)


@query
def client_usage(spark, sf):
    return cs.client_usage(X.tx_events(spark, sf))


@query
def entity_first_seen(spark, sf):
    return cs.entity_first_seen(X.tx_events(spark, sf))


# ---------------------------------------------------------------- graph

@query
def graph_hubs(spark, sf):
    return rounded(graph.hub_summary(graph.pair_totals(X.tx_events(spark, sf))))


@query
def graph_members(spark, sf):
    pairs = graph.pair_totals(X.tx_events(spark, sf))
    return rounded(graph.hub_members(pairs, graph.hub_summary(pairs)))


@query
def graph_nodes(spark, sf):
    return rounded(graph.graph_view(graph.pair_totals(X.tx_events(spark, sf)))[0])


@query
def graph_edges(spark, sf):
    return rounded(graph.graph_view(graph.pair_totals(X.tx_events(spark, sf)))[1])


# ---------------------------------------------------------------- cost model and policies

@query
def cost_lgd(spark, sf):
    return rounded(X.scored_events(spark, sf).select("tx_id", cost.loss_given_fraud().alias("loss")))


@query
def cost_clv(spark, sf):
    d = cs.with_client_value(X.scored_events(spark, sf), _summary(spark, sf))
    return rounded(d.select("tx_id", cost.client_value().alias("clv"), cost.client_value(avg=None).alias("clv_fallback")))


@query
def cost_effectiveness(spark, sf):
    d = X.scored_events(spark, sf)
    # a third of the rows without a scheme distribution
    d = d.withColumns({f"p_{s}": F.when(F.col("tx_id") % 3 == 0, 0.0).otherwise(F.col(f"p_{s}")) for s in S.SCHEMES})
    return rounded(d.select("tx_id", *[cost.stop_rate(a).alias(f"eff_{a}") for a in S.ACTIONS]))


@query
def expected_costs(spark, sf):
    d = cost.with_costs(cs.with_client_value(X.scored_events(spark, sf), _summary(spark, sf)))
    return rounded(d.select("tx_id", *[f"cost_{a}" for a in S.ACTIONS]), 2)


DECISION = ["tx_id", "action", "chosen_cost", "runner_up", "margin_to_next", "saving_vs_allow"]


@query
def decide(spark, sf):
    return rounded(_decided(spark, sf).select(*DECISION), 2)


@query
def decide_fallback(spark, sf):
    """Without client summaries the value of a client comes from the amount; all actions occur."""
    return rounded(dashboard.decided(X.scored_events(spark, sf)).select(*DECISION), 2)


@query
def decide_override(spark, sf):
    econ = Economics().override({"hold_op_cost": 400.0, "lgd_transfer": 0.7, "no_such_parameter": 1.0})
    return rounded(cost.decide(X.scored_events(spark, sf), econ, avg=None, count=None).select(*DECISION), 2)


@query
def realised_cost(spark, sf):
    d = cs.with_client_value(X.scored_events(spark, sf), _summary(spark, sf))
    return rounded(d.select("tx_id", *[cost.realised_cost(a).alias(f"real_{a}") for a in S.ACTIONS]), 4)


@query
def threshold_grid(spark, sf):
    d = cs.with_client_value(X.scored_events(spark, sf), _summary(spark, sf))
    return rounded(policies.threshold_grid(d), 2)


def _split(spark, sf):
    d = metrics.time_split(X.scored_events(spark, sf))
    return dashboard.decided(d, _summary(spark, sf))


@query
def policy_compare(spark, sf):
    return rounded(policies.compare_policies(_split(spark, sf)), 2)


@query
def policy_savings(spark, sf):
    return rounded(dashboard.policy_savings(policies.compare_policies(_split(spark, sf))), 2)


@query
def policy_summary(spark, sf):
    return rounded(policies.policy_summary(_split(spark, sf).where("split = 'test'")))


@query
def policy_per_type(spark, sf):
    return rounded(policies.policy_per_type(_split(spark, sf).where("split = 'test'")))


@query
def what_if(spark, sf):
    """Choices over the whole probability range, for every transaction, counted by type and scheme."""
    r = X.scored_events(spark, sf).select("tx_type", "amount", models.dominant_kind().alias("kind"))
    d = policies.what_if(r)
    return rounded(d.groupBy("tx_type", "kind", "p").agg(
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in S.ACTIONS],
        *[F.avg(f"cost_{a}").alias(f"cost_{a}") for a in S.ACTIONS]), 4)


@query
def decision_map(spark, sf):
    return rounded(policies.decision_map(X.scored_events(spark, sf)), 4)


@query
def cost_sensitivity(spark, sf):
    return rounded(policies.cost_sensitivity(X.scored_events(spark, sf)), 6)


# ---------------------------------------------------------------- metrics

@query
def time_split(spark, sf):
    d = X.tx_orders(spark, sf).select("tx_id", "us")
    return metrics.time_split(scan.global_index(d, ["us", "tx_id"])).select("tx_id", "row_index", "split")


@query
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(X.scored_events(spark, sf)))


@query
def average_precision(spark, sf):
    return rounded(metrics.average_precision(X.scored_events(spark, sf)))


@query
def brier(spark, sf):
    return rounded(X.scored_events(spark, sf).agg(metrics.brier().alias("brier")))


@query
def recall_at_precision(spark, sf):
    return rounded(metrics.recall_at_precision(X.scored_events(spark, sf), [0.90, 0.75, 0.50, 0.25]))


@query
def reliability_curve(spark, sf):
    return rounded(metrics.reliability_curve(X.scored_events(spark, sf)))


@query
def recall_at_budget(spark, sf):
    masks = {s: (F.col("is_fraud") == 1) & (F.col("fraud_type") == s) for s in S.SCHEMES}
    return rounded(metrics.recalls_at_budget(X.scored_events(spark, sf), masks).withColumnRenamed("name", "fraud_type"))


@query
def walkforward_folds(spark, sf):
    return metrics.fold_table(X.scored_events(spark, sf))


def _folds(spark, sf):
    return metrics.test_fold(X.scored_events(spark, sf))


@query
def walkforward_metrics(spark, sf):
    return rounded(metrics.fold_metrics(_folds(spark, sf)))


@query
def walkforward_schemes(spark, sf):
    return rounded(metrics.fold_scheme_share(_folds(spark, sf)))


@query
def metric_spread(spark, sf):
    return rounded(metrics.fold_summary(metrics.fold_metrics(_folds(spark, sf))))


@query
def type_accuracy(spark, sf):
    return rounded(metrics.type_accuracy(X.scored_events(spark, sf).withColumn("predicted_kind", _stand_in_kind())))


def _stand_in_kind():
    """A stand-in prediction that is wrong for every ninth transaction."""
    return F.when(F.col("tx_id") % 9 == 0, "fraud_ring").otherwise(models.dominant_kind())


@query
def dominant_kind(spark, sf):
    return X.scored_events(spark, sf).select("tx_id", models.dominant_kind().alias("dominant_kind"))


@query
def calibration_chain(spark, sf):
    """Supervised and anomaly scores of the test slice as probabilities, the second one capped, and both fused and calibrated again; fitted on the
    validation slice. Stand-in scores: most fall between those of the validation slice or outside them."""
    d = X.scored_events(spark, sf).withColumns({
        "p_raw": F.when(F.col("us") % 3 == 0, F.col("p_fraud") * F.col("p_fraud")).otherwise(F.col("p_fraud") * 0.9 + 0.05),
        "anomaly_score": (F.col("k") * 7 % 50 + F.col("is_fraud") * 10).cast("double") / 64})
    d = stored(metrics.time_split(d).select("tx_id", "is_fraud", "split", "p_raw", "anomaly_score"), "chain")
    # the validation slice lacks a good part of the scores
    valid = d.where("split = 'valid' AND tx_id % 5 <> 0")
    supervised = models.fit_isotonic(valid, "p_raw")
    first = models.apply_isotonic(valid, supervised, "p_raw", "p_supervised")
    anomalous, final = models.fit_fusion(first, anomaly.DEFAULT_CAP)
    d = models.apply_isotonic(d.where("split = 'test'"), supervised, "p_raw", "p_supervised")
    d = models.apply_isotonic(d, anomalous, "anomaly_score", "p_anomaly", anomaly.DEFAULT_CAP)
    d = d.withColumn("_fused", anomaly.noisy_or(F.col("p_supervised"), F.col("p_anomaly")))
    d = models.apply_isotonic(d, final, "_fused", "p_fraud")
    return rounded(d.select("tx_id", "p_supervised", "p_anomaly", "p_fraud"))


@query
def noisy_or(spark, sf):
    """An anomaly probability up to the cap joined to the supervised one by "or"."""
    raw = (F.col("k") / 200).cast("double")
    d = X.scored_events(spark, sf).select("tx_id", "p_fraud", F.least(raw, F.lit(anomaly.DEFAULT_CAP)).alias("p_anomaly"))
    return rounded(d.withColumn("p_fused", anomaly.noisy_or(F.col("p_fraud"), F.col("p_anomaly"))))


# ---------------------------------------------------------------- drift

def _windows(spark, sf):
    """Feature rows of the test slice and of the window before it."""
    side = drift.adjacent_windows(X.tx_events(spark, sf).select("tx_id", "us")).select("tx_id", "side")
    m = feature_matrix(X.tx_events(spark, sf), X.profiles(spark, sf), X.places(spark, sf))
    m = m.select("tx_id", *[half_up(f, 4).alias(f) for f in S.FEATURES])
    return m.join(side, "tx_id")


@query
def psi(spark, sf):
    return rounded(drift.psi(_windows(spark, sf)), 4)


@query
def calibration_weekly(spark, sf):
    return rounded(drift.calibration_by_week(X.scored_events(spark, sf)))


@query
def drift_gate(spark, sf):
    return rounded(drift.gate(drift.psi(_windows(spark, sf)), drift.calibration_by_week(X.scored_events(spark, sf))))


# ---------------------------------------------------------------- dashboard

@query
def stats_totals(spark, sf):
    return rounded(dashboard.stats_totals(_decided(spark, sf)))


@query
def stats_daily(spark, sf):
    return rounded(dashboard.stats_daily(_decided(spark, sf)))


@query
def stats_actions(spark, sf):
    return dashboard.stats_actions(_decided(spark, sf))


@query
def feed(spark, sf):
    d = dashboard.feed(_decided(spark, sf).withColumn("dominant_kind", models.dominant_kind()), 40, "hold")
    return rounded(d.select("tx_id", "us", "client_id", "amount", "city", "country", "merchant_category", "channel",
                            "tx_type", "p_fraud", "action", "is_fraud", "fraud_type", "dominant_kind"))


@query
def client_history(spark, sf):
    return rounded(dashboard.client_history(_decided(spark, sf)))


@query
def city_map(spark, sf):
    return rounded(dashboard.city_map(_decided(spark, sf), X.places(spark, sf)))


@query
def capacity_savings(spark, sf):
    return rounded(dashboard.hold_savings(_decided(spark, sf)).select("tx_id", "saving"), 2)


@query
def capacity_load(spark, sf):
    return rounded(dashboard.capacity_load(_decided(spark, sf)))


@query
def capacity_by_hour(spark, sf):
    return rounded(dashboard.capacity_by_hour(_decided(spark, sf)))


@query
def capacity_curve(spark, sf):
    return rounded(dashboard.capacity_curve(_decided(spark, sf)))


@query
def capacity_selected(spark, sf):
    return rounded(dashboard.nearest_operators(dashboard.capacity_curve(_decided(spark, sf)), 1))


# ---------------------------------------------------------------- explanation

EXPLAINED = [f for f in S.FEATURES if f not in S.NETWORK_FEATURES and not f.startswith("clients_per")]


def _attributed(spark, sf, d=None, features=EXPLAINED):
    """Feature rows with stand-in contributions."""
    d = d or client_features(_state(spark, sf))
    c = F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda j: (
        ((F.col("tx_id") * (j + 3) + F.col("k") * 7) % 41 - 20) / F.lit(100.0)))
    return d.withColumn("contributions", c)


@query
def top_reasons(spark, sf):
    d = _attributed(spark, sf).select("tx_id", F.posexplode(explain.top_reasons(F.col("contributions"), EXPLAINED)).alias("rank", "r"))
    return rounded(d.select("tx_id", "rank", "r.feature", "r.contribution"))


@query
def reasons(spark, sf):
    d = explain.reasons(_attributed(spark, sf).select("tx_id", "contributions"), EXPLAINED)
    return rounded(d.select("tx_id", "reason_no", "feature", "contribution", "direction"))


@query
def reason_text(spark, sf):
    """The shorter list of the feed, in words."""
    d = explain.reasons(_attributed(spark, sf), EXPLAINED, top_risk=3, top_safe=1)
    return explain.reason_text(d, features=EXPLAINED).select("tx_id", "reason_no", "feature", "text")


@query
def reason_text_languages(spark, sf):
    """Reasons over all features in every language, names of codes included."""
    d = feature_frame(X.tx_events(spark, sf), X.profiles(spark, sf), X.places(spark, sf))
    d = explain.reasons(_attributed(spark, sf, d, S.FEATURES), S.FEATURES)
    return explain.reason_texts(d).select("tx_id", "reason_no", "feature", "direction", *[f"text_{lang}" for lang in phrases.LANGUAGES])


@query
def client_message(spark, sf):
    d = dashboard.decided(X.scored_events(spark, sf)).withColumn("dominant_kind", models.dominant_kind())
    return d.select("tx_id", *[explain.client_message(lang).alias(f"message_{lang}") for lang in ("ru", "kk", "en")])


@query
def operator_script(spark, sf):
    d = dashboard.decided(X.scored_events(spark, sf)).withColumn("dominant_kind", models.dominant_kind())
    return d.select("tx_id", *[explain.operator_script(lang).alias(f"script_{lang}") for lang in ("ru", "kk", "en")])


def _explainable(spark, sf):
    """Decisions with what the search for changes needs to know about the client."""
    st = client_state(X.scored_events(spark, sf), X.profiles(spark, sf), X.places(spark, sf))
    usual = cs.client_usage(X.tx_events(spark, sf)).where("kind = 'device' AND use_rank = 1").select(
        "client_id", F.col("value").alias("usual_device"))
    home = X.places(spark, sf).select(F.col("city").alias("home_city"), F.col("country").alias("home_country"))
    d = st.withColumn("device_known", F.col("h_n_device") > 0).join(usual, "client_id", "left").join(home, "home_city", "left")
    return dashboard.decided(d.select(
        "tx_id", "amount", "tx_type", "is_vpn", "remote_access", "call_minutes_before", "device_id", "city", "country",
        "p_fraud", "p_stolen_card", "p_social_eng", "p_fraud_ring", "usual_device", "device_known", "home_city", "home_country"))


def _stand_in_scorer(d):
    """Each single change lowers the probability by its own factor; the amount does not move it."""
    factor = F.lit(1.0)
    if "field" in d.columns:
        for f, x in (("is_vpn", 0.3), ("remote_access", 0.2), ("call_minutes_before", 0.5), ("device_id", 0.4), ("city", 0.6)):
            factor = F.when(F.col("field") == f, F.lit(x)).otherwise(factor)
    return cost.decide(d.withColumn("p_fraud", F.col("_base_p") * factor), avg=None, count=None)


CHANGE = ["tx_id", "field", "was", "becomes", "action_from", "action_to", "p_from", "p_to"]


@query
def counterfactual_flips(spark, sf):
    return rounded(counterfactual.flips(_explainable(spark, sf), _stand_in_scorer).select(*CHANGE))


@query
def counterfactual_amount(spark, sf):
    d = counterfactual.amount_boundary(_explainable(spark, sf), _stand_in_scorer)
    return rounded(d.withColumn("becomes", F.col("becomes").cast("double")).select("tx_id", "becomes", "action_from", "action_to"), 2)


@query
def counterfactual_rank(spark, sf):
    d = counterfactual.find_counterfactuals(_explainable(spark, sf), _stand_in_scorer)
    return d.select("tx_id", "rank", "field", "action_from", "action_to", "text", "note")


@query
def counterfactual_languages(spark, sf):
    """What would have softened the decision, or why nothing does, in every language."""
    d = counterfactual.worded(counterfactual.find_counterfactuals(_explainable(spark, sf), _stand_in_scorer))
    return d.select("tx_id", "rank", *[f"{c}_{lang}" for lang in phrases.LANGUAGES for c in ("text", "note")])


# ---------------------------------------------------------------- replay

@query
def replay_sequence(spark, sf):
    """The last two days of every client played as a scenario on top of the history before them."""
    tx = X.scored_events(spark, sf)
    end = tx.groupBy(F.lit(0).alias("_all")).agg(F.max("us").alias("_end"))
    d = tx.withColumn("_all", F.lit(0)).join(F.broadcast(end), "_all").drop("_all")
    late = F.col("us") >= F.col("_end") - 2 * TX.DAY_US
    steps = replay.replay(d.where(~late).drop("_end"), d.where(late).drop("_end").withColumn("scenario_id", F.col("client_id")),
                          X.profiles(spark, sf), X.places(spark, sf), score=_network_scorer)
    peaks = ["tx_count_24h", "amount_to_avg", "history_len", *S.NETWORK_FEATURES]
    peak = steps.groupBy("scenario_id").agg(*[F.max(f).alias(f"max_{f}") for f in peaks])
    return rounded(replay.outcome(steps).join(peak, "scenario_id"))


def _network_scorer(d):
    """A stand-in that raises the probability with what the replayed network shows, and decides anew."""
    p = (F.col("p_fraud") / 2 + F.col("tx_count_24h") / 40 + F.col("recipient_clients_24h") / 200 + F.col("clients_per_device") / 1000
         + F.col("component_clients") / 10000)
    return cost.decide(d.withColumn("p_fraud", F.least(p, F.lit(0.99))), avg=None, count=None)


@query
def gate_reasons(spark, sf):
    return drift.gate_reasons(drift.gate(drift.psi(_windows(spark, sf)), drift.calibration_by_week(X.scored_events(spark, sf))))


# ---------------------------------------------------------------- models (rows only)

CONFIG = models.Config()
_STORED: dict[tuple[str, str], DataFrame] = {}
KEEP = ["client_id", "amount", "tx_type", "is_fraud", "fraud_type", "us"]


def stored_features(spark, sf):
    """The feature table all model queries read, stored once per session."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        order = scan.global_index(X.tx_events(spark, sf).select("tx_id", "us"), ["us", "tx_id"])
        split = metrics.time_split(order).select("tx_id", "row_index", "split")
        m = feature_matrix(X.tx_events(spark, sf), X.profiles(spark, sf), X.places(spark, sf), KEEP)
        _STORED[at] = stored(m.join(split, "tx_id"), "features")
    return _STORED[at]


_MODELS: dict[tuple[str, str], models.RiskModel] = {}


def _model(spark, sf):
    at = (spark.sparkContext.applicationId, sf)
    if at not in _MODELS:
        _MODELS[at] = models.fit(stored_features(spark, sf), CONFIG)
    return _MODELS[at]


@query
def model_scored(spark, sf):
    """The whole chain on the test slice: score, calibrate, fuse, recalibrate, scheme, decision."""
    d = _model(spark, sf).decide(stored_features(spark, sf).where("split = 'test'"))
    return d.select("tx_id", "p_raw", "p_supervised", "anomaly_score", "p_anomaly", "p_fraud",
                    *[f"p_{s}" for s in S.SCHEMES], "dominant_kind", "action", "chosen_cost", "runner_up", "is_fraud")


@query
def model_reloaded(spark, sf):
    """The chain after storing the model and reading it back."""
    path = new_path(spark, "bundle")
    _model(spark, sf).save(path)
    d = models.RiskModel.load(spark, path).decide(stored_features(spark, sf).where("split = 'test'"))
    return d.select("tx_id", "p_fraud", "action")


@query
def model_quality(spark, sf):
    d = _model(spark, sf).score(stored_features(spark, sf).where("split = 'test'")).withColumn("fold", F.lit(1))
    return metrics.fold_metrics(d).join(d.groupBy("fold").agg(
        metrics.brier("p_raw").alias("brier_raw"), metrics.brier("p_fraud").alias("brier_calibrated")), "fold")


@query
def training_curve(spark, sf):
    return models.training_curve(_model(spark, sf).fraud, stored_features(spark, sf).where("split = 'valid'"), S.FEATURES)


@query
def feature_importance(spark, sf):
    return models.feature_importance(_model(spark, sf).fraud, S.FEATURES, spark)


@query
def anomaly_scores(spark, sf):
    return _model(spark, sf).forest.score(stored_features(spark, sf), "anomaly_score").select("tx_id", "anomaly_score")


@query
def contributions(spark, sf):
    """Attribution of the test slice, with the three stored reasons."""
    d = explain.contributions(stored_features(spark, sf).where("split = 'test'"), _model(spark, sf).fraud)
    return d.select("tx_id", "contributions", "base_value", explain.top_reasons(F.col("contributions")).alias("top_reasons"))


@query
def model_counterfactuals(spark, sf):
    """Changes that soften decisions of the real model on the test slice."""
    base = stored_features(spark, sf).where("split = 'test'").select("tx_id", *[
        f for f in S.FEATURES if f in ("component_clients", "component_size")])
    history = stored(_state(spark, sf), "client-state")  # of the whole stream: the network pass and the candidates read it
    frame = saved(with_entity_features(client_features(history), X.tx_events(spark, sf), history).join(base, "tx_id"))
    usual = cs.client_usage(X.tx_events(spark, sf)).where("kind = 'device' AND use_rank = 1").select(
        "client_id", F.col("value").alias("usual_device"))
    home = X.places(spark, sf).select(F.col("city").alias("home_city"), F.col("country").alias("home_country"))
    d = _model(spark, sf).decide(frame).withColumn("device_known", F.col("h_n_device") > 0)
    d = d.drop(*[c for c in d.columns if c.startswith("cost_")]).join(usual, "client_id", "left").join(home, "home_city", "left")
    scorer = counterfactual.model_scorer(history, _model(spark, sf), X.places(spark, sf))
    return counterfactual.find_counterfactuals(d, scorer).select(*[c for c in CHANGE if c != "tx_id"], "tx_id", "rank", "text", "note")


@query
def ablation(spark, sf):
    return experiments.ablation(stored_features(spark, sf), CONFIG)


@query
def cap_sweep(spark, sf):
    return experiments.cap_sweep(stored_features(spark, sf), CONFIG)


@query
def hidden_scheme(spark, sf):
    return experiments.hidden_scheme(stored_features(spark, sf), CONFIG)


@query
def walkforward_models(spark, sf):
    return metrics.fold_metrics(experiments.walk_forward(stored_features(spark, sf), CONFIG))
