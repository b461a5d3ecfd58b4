"""Aggregates behind the dashboard: totals, series, feed, client card, map, call capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import selection
from riskloom.functions.rounding import half_up
from riskloom.operators import cost
from riskloom.sources.schema import ACTIONS, UNKNOWN_PLACE

MONTH_ROWS = 100_000  # volume the monthly figures are scaled to


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def _money(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0.0))


def stats_totals(df: DataFrame) -> DataFrame:
    """One row for the period, one pass."""
    fraud, acted = F.col("is_fraud") == 1, F.col("action") != "allow"
    g = df.agg(
        F.min("timestamp").cast("string").alias("period_from"), F.max("timestamp").cast("string").alias("period_to"),
        F.count("*").alias("transactions"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("turnover"),
        _n(fraud).alias("fraud_count"), _money(fraud).alias("fraud_amount"),
        _n(fraud & acted).alias("caught_count"), _money(fraud & acted).alias("caught_amount"),
        _n(fraud & ~acted).alias("missed_count"), _money(fraud & ~acted).alias("missed_amount"),
        _n(~fraud & acted).alias("friction_count"), _n(~fraud).alias("_honest"))
    return g.withColumns({
        "fraud_rate": F.coalesce(F.try_divide("fraud_count", "transactions"), F.lit(0.0)),
        "friction_rate": F.col("friction_count") / F.greatest(F.col("_honest"), F.lit(1)),
        "detection_rate": F.col("caught_count") / F.greatest(F.col("fraud_count"), F.lit(1)),
    }).drop("_honest")


def policy_savings(policies: DataFrame) -> DataFrame:
    """What our policy saves against the best threshold and against no system; one row."""
    paid = lambda c: F.min(F.when(c, F.col("cost")))
    p = F.col("policy")
    return policies.agg(
        paid(p == "ours").alias("cost_ours"),
        (paid(p.startswith("threshold")) - paid(p == "ours")).alias("saving_vs_threshold"),
        (paid(p == "no_system") - paid(p == "ours")).alias("saving_vs_nothing"))


def stats_daily(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(
        F.count("*").alias("transactions"), F.sum(F.col("is_fraud").cast("long")).alias("fraud"),
        F.sum("amount").alias("amount"), _n(F.col("action") == "block").alias("blocked"))


def stats_actions(df: DataFrame) -> DataFrame:
    """Count per action, also for actions that never occurred."""
    g = df.agg(*[_n(F.col("action") == a).alias(a) for a in ACTIONS])
    return g.unpivot([], ACTIONS, "action", "count")


def feed(df: DataFrame, limit: int = 40, action: str = "all", only_fraud: bool = False) -> DataFrame:
    """Newest decisions first; the limit is the feature."""
    d = df if action == "all" else df.where(F.col("action") == action)
    d = d.where(F.col("is_fraud") == 1) if only_fraud else d
    return d.orderBy(F.desc("us"), F.desc("tx_id")).limit(limit)


def client_history(df: DataFrame, last: int = 30) -> DataFrame:
    """The latest ``last`` decisions of every client; Spark cuts each map task's share of a client
    to that many rows before the shuffle."""
    w = Window.partitionBy("client_id").orderBy(F.desc("us"), F.desc("tx_id"))
    return (df.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= last)
            .select("client_id", "recent_rank", "tx_id", "us", "amount", "city", "merchant_category",
                    "p_fraud", "action", "is_fraud"))


def city_map(df: DataFrame, places: DataFrame) -> DataFrame:
    g = df.groupBy("city").agg(
        F.count("*").alias("transactions"), F.sum("amount").alias("amount"),
        F.sum(F.col("is_fraud").cast("long")).alias("fraud"), _money(F.col("is_fraud") == 1).alias("fraud_amount"),
        _n(F.col("action") == "block").alias("blocked"))
    d = g.join(places.select("city", "lat", "lon", "country"), "city", "left")
    return d.select(
        "city", F.coalesce("lat", F.lit(UNKNOWN_PLACE[0])).alias("lat"), F.coalesce("lon", F.lit(UNKNOWN_PLACE[1])).alias("lon"),
        F.coalesce("country", F.lit(UNKNOWN_PLACE[2])).alias("country"),
        (F.coalesce("country", F.lit(UNKNOWN_PLACE[2])) != "KZ").alias("foreign"),
        "transactions", "amount", "fraud", "fraud_amount", "blocked",
        (F.col("fraud") / F.greatest(F.col("transactions"), F.lit(1))).alias("fraud_rate"))


def hold_savings(df: DataFrame) -> DataFrame:
    """Held transactions with what the call is expected to save (costs must be present)."""
    return df.where(F.col("action") == "hold").withColumn(
        "saving", F.greatest(F.col("cost_allow") - F.col("cost_hold"), F.lit(0.0)))


def _period(df: DataFrame) -> DataFrame:
    """Whole days and rows of the feed; one row."""
    days = F.floor((F.max("us") - F.min("us")) / F.lit(86_400_000_000))
    return df.agg(F.greatest(days, F.lit(1)).alias("days"), F.count("*").alias("feed_rows")).withColumn("_all", F.lit(0))


def capacity_load(df: DataFrame, call_minutes: float = 6.0, shift_hours: float = 8.0) -> DataFrame:
    """Calls, peak hour and operators the policy needs; one row."""
    h = hold_savings(df)
    hourly = h.groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("calls"), F.sum("saving").alias("saving"))
    peak = hourly.agg(
        F.sum("calls").alias("holds"), F.sum("saving").alias("_saving"),
        F.max(F.struct("calls", (-F.col("hour")).alias("_h"))).alias("_peak")).withColumn("_all", F.lit(0))
    per_shift = shift_hours * 60.0 / call_minutes
    factor = F.lit(float(MONTH_ROWS)) / F.greatest(F.col("feed_rows"), F.lit(1))
    d, n = F.col("days"), F.col("holds")
    return peak.join(_period(df), "_all").where(n > 0).select(
        "holds", "days",
        F.bround(n * factor, 0).cast("long").alias("monthly_calls"),
        half_up(n * factor / 30.0 / per_shift, 2).alias("monthly_operators"),
        half_up(F.col("_saving") * factor, 2).alias("monthly_saving"),
        half_up(n / d, 1).alias("calls_per_day"),
        (-F.col("_peak._h")).alias("peak_hour"),
        half_up(F.col("_peak.calls") / d, 1).alias("peak_calls_per_hour"),
        half_up(F.lit(per_shift), 1).alias("calls_per_operator_shift"),
        half_up(n / d / per_shift, 2).alias("operators_needed_average"),
        half_up(F.col("_peak.calls") / d / (60.0 / call_minutes), 2).alias("operators_needed_peak"),
        half_up("_saving", 2).alias("total_expected_saving"),
        half_up(F.col("_saving") / n, 2).alias("saving_per_call"))


def capacity_by_hour(df: DataFrame) -> DataFrame:
    g = df.where(F.col("action") == "hold").groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("calls"))
    return g.withColumn("_all", F.lit(0)).join(_period(df), "_all").select(
        "hour", half_up(F.col("calls") / F.col("days"), 2).alias("calls"))


def capacity_curve(df: DataFrame, call_minutes: float = 6.0, shift_hours: float = 8.0) -> DataFrame:
    """Value captured by the best 0, 10 .. 100 % of the calls."""
    per_shift = shift_hours * 60.0 / call_minutes
    # a narrow table of the held transactions, so decisions are computed once
    order = ["_down", "tx_id"]
    h = selection.narrow(hold_savings(df), "tx_id", "saving", (-F.col("saving")).alias("_down"))
    holds = h.count()
    ends = sorted({round(i / 10 * holds) for i in range(11)} - {0})  # halves go to the even number
    _, last = selection.rows_at(h, order, lambda n: {str(e): e - 1 for e in ends})
    # each call belongs to the step whose last call is not before it
    step_of = sum(((~selection.at_or_before(order, last[str(e)])).cast("int") for e in ends), F.lit(0))
    parts = {r["step"]: r["saving"] for r in h.groupBy(step_of.alias("step")).agg(F.sum("saving").alias("saving")).collect()}  # ten rows
    got, best = [], 0.0
    for i, e in enumerate(ends):
        best += parts[i]
        got.append((e, best))
    got = df.sparkSession.createDataFrame(got, "_calls long, _got double")
    steps = _period(df).select("days", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.struct(
        (i / 10.0).alias("share"), F.bround(i / 10.0 * F.lit(holds), 0).cast("long").alias("calls")))).alias("s"), F.lit(best).alias("_total")).where(F.lit(holds > 0))
    return steps.join(F.broadcast(got), F.col("s.calls") == F.col("_calls"), "left").select(
        F.col("s.share").alias("share_of_calls"), F.col("s.calls").alias("calls"),
        (F.coalesce("_got", F.lit(0.0)) / F.when(F.col("_total") == 0, F.lit(1.0)).otherwise(F.col("_total"))).alias("share_of_value"),
        half_up(F.col("s.calls") / F.col("days") / per_shift, 2).alias("operators"))


def nearest_operators(curve: DataFrame, operators: int) -> DataFrame:
    """The point of the curve nearest to a number of operators, the first of equally near ones."""
    near = F.struct(F.abs(F.col("operators") - operators).alias("d"), "share_of_calls", "calls", "share_of_value", "operators")
    return curve.agg(F.min(near).alias("m")).select("m.share_of_calls", "m.calls", "m.share_of_value", "m.operators")


def decided(scored: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Scored transactions with their decision; without a summary the client value falls back to
    the amount."""
    from riskloom.operators.client_summary import with_client_value

    if summary is None:
        return cost.decide(scored, avg=None, count=None)
    return cost.decide(with_client_value(scored, summary))
