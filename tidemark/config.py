"""All thresholds, as frozen values that every operator takes as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR, DAY = 3_600, 86_400


@dataclass(frozen=True)
class FeatureConfig:
    # They define the features.
    week: int = 7 * DAY
    month: int = 30 * DAY
    two_days: int = 48 * HOUR
    min_history: int = 5
    min_sigma: float = 1e-9
    round_cents: int = 100_000
    ratio_cap: float = 10.0
    #: A hot entity or counterparty is dealt out by spans of so many seconds; results don't depend on it.
    chunk: int = 7 * DAY


@dataclass(frozen=True)
class RuleConfig:
    # They define the rules.
    r1_deposits: int = 3
    r1_floor: int = 750_000
    r1_ceiling: int = 999_999
    r1_window: int = 7 * DAY
    r2_inbound: int = 1_500_000
    r2_legs: int = 3
    r2_counterparties: int = 3
    r2_passthrough: float = 0.70
    r2_window: int = 48 * HOUR
    r3_senders: int = 8
    r3_cv: float = 0.35
    r3_mean: int = 500_000
    r3_window: int = 72 * HOUR
    r4_prior: int = 10
    r4_zscore: float = 2.0
    r5_days: float = 90.0
    r5_multiple: float = 4.0
    cash_total: int = 1_000_000
    cash_window: int = DAY
    lateness: int = 12 * HOUR


@dataclass(frozen=True)
class ScoreConfig:
    # Blend, grid and illustrative costs.
    rule_weight: float = 0.60
    model_weight: float = 0.40
    saturation: int = 2
    steps: int = 1_000
    investigation_cost: float = 85.00 * 2.5
    miss_cost: float = 25_000.00
    miss_costs: tuple[float, ...] = (5_000.00, 25_000.00, 100_000.00)
    weekly_capacity: float = 4 * 30.0 / 2.5
    weeks: float = 52.0
    naive_cents: int = 1_000_000


@dataclass(frozen=True)
class PolicyConfig:
    # Priority bands (name, minimum score, hours due) and rule -> typology.
    bands: tuple[tuple[str, float, int], ...] = (("P0", 67.9, 4), ("P1", 55.0, 24), ("P2", 39.6, 72))
    typologies: tuple[tuple[str, str, str], ...] = (
        ("R1_STRUCTURING", "T01-STRUCTURING", "Structuring"),
        ("R2_LAYERING", "T02-LAYERING", "Layering"),
        ("R3_SMURFING", "T03-SMURFING", "Smurfing"),
        ("R4_ROUND_DOLLAR", "T04-ROUND-DOLLAR", "Round dollar"),
        ("R5_DORMANT", "T05-DORMANT", "Dormant reactivation"),
    )


@dataclass(frozen=True)
class KycConfig:
    # Points, bands, review months, ownership line.
    segment_points: dict[str, int] = field(
        default_factory=lambda: {"salaried": 0, "retired": 0, "gig": 1, "self_employed": 1, "ecommerce": 1, "wholesale": 1, "professional_services": 2, "retail_cash_intensive": 3}
    )
    points: dict[str, int] = field(
        default_factory=lambda: {
            "business": 1, "domestic_pep_or_hio": 2, "non_face_to_face": 1, "adverse_media": 3, "layered_ownership": 2, "opaque_jurisdiction": 2, "no_25pct_owner": 1,
            "activity_over_3x_declared": 2, "activity_over_1_5x_declared": 1, "cash_over_half_of_inflows": 1, "wires_over_fifth_of_outflows": 1, "monitoring_alert": 2,
        }
    )
    high: int = 6
    medium: int = 3
    review_months: dict[str, int] = field(default_factory=lambda: {"High": 12, "Medium": 24, "Low": 36})
    owner_line: float = 0.25
    as_of: str = "2026-07-31"


# The rules' codes.
RULES = ("R1_STRUCTURING", "R2_LAYERING", "R3_SMURFING", "R4_ROUND_DOLLAR", "R5_DORMANT")
# The feature columns.
FEATURES = (
    "txn_count_7d", "txn_sum_7d_cents", "txn_count_30d", "txn_sum_30d_cents", "amount_zscore_entity", "is_round_amount", "days_since_prev_txn", "distinct_counterparties_7d",
    "outbound_to_inbound_ratio_48h", "cash_ratio_7d", "counterparty_entity_degree_asof", "counterparty_age_days", "new_counterparty_ratio_7d", "hour_of_day", "is_weekend",
)
# The columns of ground truth.
TRUTH = ("is_suspicious", "typology", "typology_variant", "case_id")
