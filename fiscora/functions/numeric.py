"""Column expressions on amounts, labels, bands and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Rurality code ceilings and their tiers.
RURAL_EDGES, RURAL_LABELS = (3, 5, 7), ("Metro", "Micropolitan", "Small Town", "Remote Rural")
# Mean bed counts (exclusive ceilings) and size classes.
BED_EDGES, BED_LABELS = (25, 100, 250), (
    "Critical Access", "Small Rural", "Medium Rural", "Large Rural")
# Lowest score per risk tier, highest tier first.
TIER_FLOORS = ((0.6, "HIGH"), (0.35, "ELEVATED"))
LOWEST_TIER = "LOW"
# Fixed value: decision threshold of the classification report.
DECISION_THRESHOLD = 0.4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double where den > 0, otherwise NULL (also under ANSI)."""
    num, den = _col(num), _col(den)
    return F.when(den > 0, num.cast("double") / den).cast("double")


def horizon_label(event: Column | str, observed: Column | str, n: int = 3) -> Column:
    """1 if the event falls in the ``n`` years after the observed year, else 0."""
    gap = _col(event) - _col(observed)
    return F.coalesce(F.when((gap > 0) & (gap <= n), 1), F.lit(0)).cast("int")


def band(c: Column | str, edges: Sequence[float], labels: Sequence[str],
         null_label: str | None = None, inclusive: bool = True) -> Column:
    """Name of the first band whose ceiling holds ``c``; the last label is open."""
    c = _col(c)
    ladder = F.when(c.isNull(), F.lit(null_label))
    for edge, label in zip(edges, labels):
        ladder = ladder.when(c <= edge if inclusive else c < edge, label)
    return ladder.otherwise(labels[-1])


def rural_level(c: Column | str) -> Column:
    return band(c, RURAL_EDGES, RURAL_LABELS)


def bed_size(c: Column | str) -> Column:
    """Size class; an unknown bed count counts as the largest class."""
    return band(c, BED_EDGES, BED_LABELS, null_label=BED_LABELS[-1], inclusive=False)


def completeness(cols: Sequence[str]) -> Column:
    """Number of columns that hold a value."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])


def risk_tier(p: Column | str, floors: Sequence[tuple[float, str]] = TIER_FLOORS,
              lowest: str = LOWEST_TIER) -> Column:
    p = _col(p)
    ladder = F.when(p.isNull(), F.lit(None).cast("string"))
    for floor, tier in floors:
        ladder = ladder.when(p >= floor, tier)
    return ladder.otherwise(lowest)


def round_score(p: Column | str, digits: int = 4) -> Column:
    return F.round(_col(p), digits)


def apply_threshold(p: Column | str, threshold: float = DECISION_THRESHOLD) -> Column:
    return (_col(p) >= threshold).cast("int")


def cap_upper(c: Column | str, cap: Column) -> Column:
    """Clip from above; NULL stays NULL and a NULL cap clips nothing."""
    c = _col(c)
    return F.when(c > cap, cap).otherwise(c)


def fill_with(c: Column | str, value: Column) -> Column:
    return F.coalesce(_col(c), value)


def standardize(c: Column | str, mean: Column, std: Column) -> Column:
    """z-score; a constant column is only centred."""
    return (_col(c) - mean) / F.when(std == 0, 1.0).otherwise(std)


def inf_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.abs(c) == float("inf"), None).otherwise(c)


def missing_to_null(c: Column | str) -> Column:
    """NaN counts as missing."""
    c = _col(c)
    return F.when(F.isnan(c), None).otherwise(c)


def yoy(current: Column | str, prior: Column | str) -> Column:
    """Relative change against the prior value where that is positive."""
    return safe_ratio(_col(current) - _col(prior), prior)


# The sixteen amounts of a filing.
FINANCIAL_COLUMNS = (
    "total_patient_revenue", "net_patient_revenue", "total_costs", "net_income",
    "less_total_operating_expense", "number_of_beds", "inpatient_total_charges",
    "medicaid_charges", "total_days_title_xviii", "total_days_title_xix",
    "cash_on_hand_and_in_banks", "total_current_assets", "total_current_liabilities",
    "depreciation_cost", "cost_of_charity_care", "total_bad_debt_expense",
)

# The ten model features in model order.
FEATURE_COLUMNS = (
    "operating_margin", "total_margin", "cost_to_revenue", "medicaid_pct",
    "medicare_day_pct", "occupancy_proxy", "days_cash_on_hand", "current_ratio",
    "uncompensated_care_pct", "revenue_yoy_change",
)


def ratio_columns() -> Mapping[str, Column]:
    """The nine ratios of one filing; the tenth needs the filing before it."""
    net, gross = F.col("net_patient_revenue"), F.col("total_patient_revenue")
    costs, beds = F.col("total_costs"), F.col("number_of_beds")
    day_medicare = F.col("total_days_title_xviii")
    government_days = day_medicare + F.col("total_days_title_xix")
    return {
        "operating_margin": safe_ratio(net - F.col("less_total_operating_expense"), net),
        "total_margin": safe_ratio("net_income", net),
        "cost_to_revenue": safe_ratio(costs, net),
        "medicaid_pct": safe_ratio("medicaid_charges", gross),
        "medicare_day_pct": safe_ratio(day_medicare, government_days),
        "occupancy_proxy": safe_ratio(government_days, beds * 365.0),
        "days_cash_on_hand": safe_ratio("cash_on_hand_and_in_banks", costs / 365.0),
        "current_ratio": safe_ratio("total_current_assets", "total_current_liabilities"),
        "uncompensated_care_pct": safe_ratio(
            F.col("cost_of_charity_care") + F.col("total_bad_debt_expense"), gross),
    }


PAYER_RATIOS = ("medicaid_pct", "medicare_day_pct", "uncompensated_care_pct")
