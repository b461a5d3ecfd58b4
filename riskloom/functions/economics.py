"""Parameters of the cost model. All amounts in KZT."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace


def _stop_rates() -> dict[str, dict[str, float]]:
    # ---- fixed values: chance that an action stops a scheme -------------------------------
    return {
        "allow": {"stolen_card": 0.00, "social_eng": 0.00, "fraud_ring": 0.00},
        "step_up": {"stolen_card": 0.85, "social_eng": 0.10, "fraud_ring": 0.55},
        "hold": {"stolen_card": 0.93, "social_eng": 0.80, "fraud_ring": 0.85},
        "block": {"stolen_card": 0.99, "social_eng": 0.60, "fraud_ring": 0.97},
    }


@dataclass(frozen=True)
class Economics:
    # ---- fixed values: defaults of the cost model -----------------------------------------
    lgd_transfer: float = 0.92
    lgd_purchase: float = 0.60
    lgd_withdrawal: float = 1.00
    case_handling_cost: float = 5000.0
    step_up_op_cost: float = 30.0
    hold_op_cost: float = 1500.0
    step_up_abandon_rate: float = 0.04
    step_up_annoyance: float = 120.0
    step_up_friction_rate: float = 0.0015
    hold_abandon_rate: float = 0.18
    hold_annoyance: float = 1200.0
    hold_friction_rate: float = 0.006
    merchant_margin: float = 0.015
    block_churn_rate: float = 0.11
    clv_cap: float = 1200000.0
    clv_default: float = 180000.0
    effectiveness: dict = field(default_factory=_stop_rates)

    def override(self, values: dict | None) -> "Economics":
        """Known keys replace defaults, unknown keys are ignored."""
        names = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in (values or {}).items() if k in names})

    def scaled(self, factor: float) -> "Economics":
        """All stop rates but those of ``allow`` times a factor, kept within 0 and 0.99."""
        return replace(self, effectiveness={
            a: (dict(t) if a == "allow" else
                {k: min(0.99, max(0.0, v * factor)) for k, v in t.items()})
            for a, t in self.effectiveness.items()})

    def to_dict(self) -> dict:
        return asdict(self)


CLV_FLOOR = 25000.0
CLV_MONTHS = 36.0
CLV_AMOUNT_FACTOR = 4.0
