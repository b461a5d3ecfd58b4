"""Policies in money: thresholds against the cheapest action, grids, maps and sensitivity."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.economics import Economics
from riskloom.functions.rounding import half_up
from riskloom.operators import cost
from riskloom.sources.schema import ACTIONS, SCHEMES

GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def _sum_of(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def _per_step(df: DataFrame, keys: list[str], grid: list[float], econ: Economics) -> DataFrame:
    """Totals per grid step a probability reaches. The table is read once whatever the grid size."""
    step = sum(((F.col("p_fraud") >= t).cast("int") for t in grid), F.lit(0))
    ours = {"_ours": cost.realised_cost(F.col("action"), econ)} if "action" in df.columns else {}
    paid = {"_block": cost.realised_cost("block", econ), "_allow": cost.realised_cost("allow", econ), **ours}
    return (df.select(*keys, step.alias("_step"), *[c.alias(n) for n, c in paid.items()])
            .groupBy(*keys, "_step").agg(*[F.sum(n).alias(n) for n in paid]))


def _grid_totals(per_step: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Cost of "block from t on" per threshold: steps at or above t block, the others allow."""
    at = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid)]))
    paid = F.when(F.col("_step") >= F.col("g.i"), F.col("_block")).otherwise(F.col("_allow"))
    return per_step.select("*", at.alias("g")).groupBy(*keys, F.col("g.t").alias("threshold")).agg(
        F.sum(paid).alias("total_cost"), *[F.sum(c).alias(c) for c in ("_allow", "_ours") if c in per_step.columns])


def threshold_grid(df: DataFrame, grid: list[float] = GRID, econ: Economics = cost.DEFAULT) -> DataFrame:
    """Realised cost of "block from t on" for every t of the grid."""
    return _grid_totals(_per_step(df, [], grid, econ), [], grid).select("threshold", "total_cost")


def best_threshold(df: DataFrame, grid: list[float] = GRID, econ: Economics = cost.DEFAULT) -> DataFrame:
    """The cheapest threshold, the lowest of equally cheap ones; one row."""
    g = threshold_grid(df, grid, econ)
    return g.agg(F.min(F.struct("total_cost", "threshold")).alias("b")).select(
        F.col("b.threshold").alias("threshold"), F.col("b.total_cost").alias("total_cost"))


def compare_policies(df: DataFrame, grid: list[float] = GRID, econ: Economics = cost.DEFAULT) -> DataFrame:
    """Cost on the rows of split = test of our policy (column ``action``), of no system and of two
    fixed thresholds, the better one chosen on split = valid. One pass over the table; everything
    after the first aggregation is a handful of rows."""
    d = df.where(F.col("split").isin("valid", "test"))
    g = _grid_totals(_per_step(d, ["split"], grid, econ), ["split"], grid)
    valid, test = F.col("split") == "valid", F.col("split") == "test"
    one = g.agg(
        F.min(F.when(valid, F.struct("total_cost", "threshold"))).alias("best"),
        F.map_from_entries(F.collect_list(F.when(test, F.struct("threshold", "total_cost")))).alias("at"),
        F.max(F.when(test, F.col("_allow"))).alias("no_system"), F.max(F.when(test, F.col("_ours"))).alias("ours"))

    def row(name: str, threshold: Column, paid: Column) -> Column:
        return F.struct(F.lit(name).alias("policy"), threshold.cast("double").alias("threshold"), paid.alias("cost"))

    none, best = F.lit(None), F.col("best.threshold")
    return one.select(F.explode(F.array(
        row("ours", none, F.col("ours")), row("no_system", none, F.col("no_system")),
        row("threshold_0.50", F.lit(0.5), F.try_element_at("at", F.lit(0.5))),
        row("threshold_best", best, F.try_element_at("at", best)))).alias("r")).select("r.*")


def policy_summary(df: DataFrame) -> DataFrame:
    """Load, friction and detection of the chosen actions; one row."""
    fraud, acted = F.col("is_fraud") == 1, F.col("action") != "allow"
    return df.agg(
        F.count("*").alias("transactions"),
        *[_sum_of(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS],
        F.coalesce(F.try_divide(_sum_of(~fraud & acted), _sum_of(~fraud)), F.lit(0.0)).alias("friction_rate_honest"),
        F.coalesce(F.try_divide(_sum_of(fraud & acted), _sum_of(fraud)), F.lit(0.0)).alias("detection_rate"))


def policy_per_type(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_fraud") == 1).where(F.col("fraud_type").isin(SCHEMES)).groupBy("fraud_type").agg(
        F.count("*").alias("count"),
        F.avg((F.col("action") != "allow").cast("double")).alias("detected_share"),
        *[_sum_of(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS],
        F.avg("p_fraud").alias("mean_p"))


def scheme_probs(kind: Column) -> dict[str, Column]:
    """0.9 for the assumed scheme and 0.05 for the others."""
    return {s: F.when(kind == s, F.lit(0.9)).otherwise(F.lit(0.05)) for s in SCHEMES}


def what_if(requests: DataFrame, econ: Economics = cost.DEFAULT, keep: list[str] | None = None) -> DataFrame:
    """Costs and choice for each request (``amount``, ``tx_type``, ``kind``) at p = 0, 0.02 .. 1."""
    d = requests.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(50))))
    d = d.withColumn("p", F.round(F.col("p") * 2 / 100, 2))
    d = cost.with_costs(d, econ, p="p", probs=scheme_probs(F.col("kind")), avg=None, count=None)
    d = d.withColumn("action", cost.cheapest({a: f"cost_{a}" for a in ACTIONS}))
    return d.select(*(keep or requests.columns), "p", "action", *[f"cost_{a}" for a in ACTIONS])


def decision_map(tx: DataFrame, n_amount: int = 26, n_p: int = 41, amount_min: float | None = None,
                 amount_max: float | None = None, econ: Economics = cost.DEFAULT) -> DataFrame:
    """Cheapest action over (log-spaced amount, probability) for every transaction type and scheme.
    The amount range is that of the data unless given."""
    lo = F.lit(float(amount_min)) if amount_min else F.min(F.when(F.col("amount") > 0, F.col("amount")))
    hi = F.lit(float(amount_max)) if amount_max else F.max("amount")
    r = tx.groupBy("tx_type").agg(lo.alias("_lo"), hi.alias("_hi")).where(F.col("_lo").isNotNull())
    r = r.withColumns({"_a": F.log("_lo"), "_b": F.log(F.greatest(F.col("_hi"), F.col("_lo") * 2))})
    d = (r.withColumn("kind", F.explode(F.array(*[F.lit(s) for s in SCHEMES])))
         .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_amount - 1))))
         .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1)))))
    d = d.withColumns({
        "amount": F.exp(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("i") / (n_amount - 1)),
        "p": F.col("j") / (n_p - 1)})
    d = cost.with_costs(d, econ, p="p", probs=scheme_probs(F.col("kind")), avg=None, count=None)
    return d.select("tx_type", "kind", "i", "j", half_up("amount", 2).alias("amount"),
                    half_up("p", 4).alias("p"), cost.cheapest({a: f"cost_{a}" for a in ACTIONS}).alias("action"))


def variants(base: Economics = cost.DEFAULT) -> dict[str, Economics]:
    """The perturbed cost models of the sensitivity report."""
    return {
        "effectiveness_down_25": base.scaled(0.75),
        "effectiveness_up_25": base.scaled(1.25),
        "case_handling_x2": replace(base, case_handling_cost=base.case_handling_cost * 2),
        "hold_call_x2": replace(base, hold_op_cost=base.hold_op_cost * 2),
        "block_churn_x2": replace(base, block_churn_rate=base.block_churn_rate * 2),
        "transfer_lgd_070": replace(base, lgd_transfer=0.70),
    }


def cost_sensitivity(scored: DataFrame, worlds: dict[str, Economics] | None = None,
                     base: Economics = cost.DEFAULT) -> DataFrame:
    """If we decide with ``base`` but another cost model is true: how many decisions would change
    and what the wrong ones cost, in expectation. Client value is left out, as in the report."""
    flat = [n for n in base.to_dict() if n != "effectiveness"]
    worlds = worlds or variants(base)

    def literal(name: str, e: Economics) -> Column:
        return F.struct(F.lit(name).alias("parameter"), *[F.lit(getattr(e, n)).alias(n) for n in flat],
                        *[F.lit(e.effectiveness[a][s]).alias(f"eff_{a}_{s}") for a in ACTIONS for s in SCHEMES])

    probs = {s: F.col(f"p_{s}") for s in SCHEMES}
    names = {a: f"cost_{a}" for a in ACTIONS}
    d = cost.with_costs(scored.select("p_fraud", "amount", "tx_type", *[f"p_{s}" for s in SCHEMES]),
                        base, probs=probs, avg=None, count=None)
    d = d.withColumn("_base", cost.cheapest(names)).drop(*names.values())
    d = d.withColumn("w", F.explode(F.array(*[literal(n, e) for n, e in worlds.items()])))
    true = Economics(**{n: F.col(f"w.{n}") for n in flat}, effectiveness={
        a: {s: F.col(f"w.eff_{a}_{s}") for s in SCHEMES} for a in ACTIONS})
    d = cost.with_costs(d, true, probs=probs, avg=None, count=None).withColumn("_ideal", cost.cheapest(names))

    def paid(choice: str) -> Column:
        out = F.col("cost_block")
        for a in ACTIONS[:-1]:
            out = F.when(F.col(choice) == a, F.col(f"cost_{a}")).otherwise(out)
        return out

    g = d.groupBy(F.col("w.parameter").alias("parameter")).agg(
        F.avg((F.col("_base") != F.col("_ideal")).cast("double")).alias("changed_share"),
        F.sum(paid("_base")).alias("_ours"), F.sum(paid("_ideal")).alias("_best"))
    return g.select("parameter", "changed_share",
                    F.coalesce(F.try_divide(F.col("_ours") - F.col("_best"), F.col("_best")), F.lit(0.0)).alias("regret_share"),
                    half_up(F.col("_ours") - F.col("_best"), 2).alias("regret_absolute"))
