"""Expected cost of the four actions and the cheapest choice, as column expressions.

Nothing here shuffles: all functions return columns over one row with ``p_fraud``, ``amount``,
``tx_type``, the scheme probabilities ``p_<scheme>`` and, for the client value, ``client_avg`` and
``client_count`` (both null when the client is unknown).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.economics import (CLV_AMOUNT_FACTOR, CLV_FLOOR, CLV_MONTHS, Economics)
from riskloom.functions.rounding import half_up
from riskloom.sources.schema import ACTIONS, SCHEMES

DEFAULT = Economics()


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _add(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def loss_given_fraud(econ: Economics = DEFAULT, amount="amount", tx_type="tx_type") -> Column:
    rate = (F.when(_c(tx_type) == "transfer", F.lit(econ.lgd_transfer))
            .when(_c(tx_type) == "withdrawal", F.lit(econ.lgd_withdrawal))
            .otherwise(F.lit(econ.lgd_purchase)))
    return _c(amount) * rate + econ.case_handling_cost


def client_value(econ: Economics = DEFAULT, amount="amount", avg="client_avg",
                 count="client_count") -> Column:
    """Lifetime value from the client's ticket and activity; from the amount when there is none."""
    from_amount = F.least(F.greatest(F.lit(econ.clv_default), _c(amount) * CLV_AMOUNT_FACTOR),
                          F.lit(econ.clv_cap))
    if avg is None:
        return from_amount
    known = (F.coalesce(_c(avg), F.lit(0.0)) > 0) & (F.coalesce(_c(count), F.lit(0.0)) > 0)
    turnover = _c(avg) * F.greatest(_c(count), F.lit(1.0)) * econ.merchant_margin * CLV_MONTHS
    return F.when(known, F.least(F.greatest(turnover, F.lit(CLV_FLOOR)), F.lit(econ.clv_cap))
                  ).otherwise(from_amount)


def stop_rate(action: str, econ: Economics = DEFAULT, probs: dict | None = None) -> Column:
    """Chance that the action stops the fraud, weighted by scheme; the plain mean without weights."""
    probs = probs or {s: f"p_{s}" for s in SCHEMES}
    table = econ.effectiveness[action]
    weight = {s: F.greatest(F.coalesce(_c(probs[s]), F.lit(0.0)), F.lit(0.0)) for s in SCHEMES}
    total = _add(weight.values())
    mean = sum(table[s] for s in SCHEMES) / len(SCHEMES)
    return F.when(total > 0, F.try_divide(_add(weight[s] * table[s] for s in SCHEMES), total)
                  ).otherwise(F.lit(mean))


def friction(action: str, econ: Economics = DEFAULT, amount="amount", clv: Column | None = None) -> Column:
    """What the action costs when the transaction was honest, without its own operating cost."""
    margin = _c(amount) * econ.merchant_margin
    if action == "step_up":
        return (margin * econ.step_up_abandon_rate + econ.step_up_annoyance
                + _c(amount) * econ.step_up_friction_rate)
    if action == "hold":
        return (margin * econ.hold_abandon_rate + econ.hold_annoyance
                + _c(amount) * econ.hold_friction_rate)
    if action == "block":
        return margin + clv * econ.block_churn_rate
    return F.lit(0.0)


def operating_cost(action: str, econ: Economics = DEFAULT) -> float:
    return {"step_up": econ.step_up_op_cost, "hold": econ.hold_op_cost}.get(action, 0.0)


def expected_costs(econ: Economics = DEFAULT, p="p_fraud", amount="amount", tx_type="tx_type",
                   probs: dict | None = None, avg="client_avg", count="client_count") -> dict[str, Column]:
    p = F.least(F.greatest(_c(p), F.lit(0.0)), F.lit(1.0))
    loss = loss_given_fraud(econ, amount, tx_type)
    clv = client_value(econ, amount, avg, count)
    out = {"allow": half_up(p * loss)}
    for a in ACTIONS[1:]:
        missed = p * (1.0 - stop_rate(a, econ, probs)) * loss
        out[a] = half_up(missed + operating_cost(a, econ) + (1.0 - p) * friction(a, econ, amount, clv))
    return out


def with_costs(df: DataFrame, econ: Economics = DEFAULT, prefix: str = "cost_", **kw) -> DataFrame:
    return df.withColumns({f"{prefix}{a}": c for a, c in expected_costs(econ, **kw).items()})


def cheapest(costs: dict[str, Column | str]) -> Column:
    """The cheapest action, ties go to the milder one. Built from comparisons, so it stays in codegen."""
    best = F.least(*[_c(costs[a]) for a in ACTIONS])
    out = F.lit(ACTIONS[-1])
    for a in reversed(ACTIONS[:-1]):
        out = F.when(_c(costs[a]) == best, a).otherwise(out)
    return out


def decide(df: DataFrame, econ: Economics = DEFAULT, **kw) -> DataFrame:
    """Add the four costs, the action, its cost, the runner-up, the margin to it and the saving."""
    d = with_costs(df, econ, **kw)
    ranked = F.array_sort(F.array(*[
        F.struct(F.col(f"cost_{a}").alias("cost"), F.lit(i).alias("rank"), F.lit(a).alias("action"))
        for i, a in enumerate(ACTIONS)]))
    return d.withColumn("_ranked", ranked).withColumns({
        "action": F.col("_ranked")[0]["action"],
        "chosen_cost": F.col("_ranked")[0]["cost"],
        "runner_up": F.col("_ranked")[1]["action"],
        "margin_to_next": half_up(F.col("_ranked")[1]["cost"] - F.col("_ranked")[0]["cost"]),
        "saving_vs_allow": half_up(F.col("cost_allow") - F.col("_ranked")[0]["cost"]),
    }).drop("_ranked")


def realised_cost(action, econ: Economics = DEFAULT, amount="amount", tx_type="tx_type",
                  avg="client_avg", count="client_count") -> Column:
    """Cost of an action once the label (``is_fraud``, ``fraud_type``) is known; ``action`` is an
    action name or a column of names."""
    loss = loss_given_fraud(econ, amount, tx_type)
    clv = client_value(econ, amount, avg, count)
    scheme = F.when(F.coalesce(F.col("fraud_type"), F.lit("")) == "", "stolen_card").otherwise(F.col("fraud_type"))

    def one(a: str) -> Column:
        rate = F.lit(0.0)
        for s in SCHEMES:
            rate = F.when(scheme == s, F.lit(econ.effectiveness[a][s])).otherwise(rate)
        honest = operating_cost(a, econ) + friction(a, econ, amount, clv)
        return F.when(F.col("is_fraud") == 1, (1.0 - rate) * loss + operating_cost(a, econ)).otherwise(honest)

    if isinstance(action, str) and action in ACTIONS:
        return one(action)
    out = one(ACTIONS[-1])
    for a in ACTIONS[:-1]:
        out = F.when(_c(action) == a, one(a)).otherwise(out)
    return out


def threshold_action(p, threshold: float = 0.5) -> Column:
    return F.when(_c(p) >= threshold, "block").otherwise("allow")
