"""Column expressions of the customer-value domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROSS_MARGIN = 0.68
#: Rates of uplift and cost by action, and what they apply to.
POLICIES = {
    "Retention Campaign": (0.35, 0.08, "ltv"),
    "Upsell Offer": (0.15, 0.05, "ltv"),
    "Reduce Acquisition Spend": (0.50, 0.01, "cac"),
    "Nurture": (0.03, 0.02, "ltv"),
}
DEFAULT_ACTION = "Nurture"


def clamp(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Null stays null (greatest and least would skip it)."""
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNotNull(), out)


def try_number(c: Column, kind: str) -> Column:
    return c.cast("string").try_cast(kind)


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def months_between_months(a: Column, b: Column) -> Column:
    """Whole calendar months from b to a; may be negative."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def retention_months(churn: Column) -> Column:
    return 1 / clamp(churn, 0.05, 0.99)


def lifetime_value(arpu: Column, churn: Column, margin: float = GROSS_MARGIN) -> Column:
    return clamp(arpu * retention_months(churn) * F.lit(margin), 0.0)


def ranked_action(churn: Column, ltv: Column, cac: Column, high: Column, low: Column, usual_cac: Column) -> Column:
    """The batch rule, by quantiles of the whole table."""
    return (
        F.when(churn > 0.7, "Retention Campaign")
        .when((ltv > high) & (churn < 0.4), "Upsell Offer")
        .when((ltv < low) & (cac > usual_cac), "Reduce Acquisition Spend")
        .otherwise(DEFAULT_ACTION)
    )


def scored_action(churn: Column, following: Column) -> Column:
    """The rule for single records, by fixed thresholds."""
    return (
        F.when(churn >= 0.7, "Retention Campaign")
        .when(following >= 0.6, "Upsell Offer")
        .when((churn <= 0.25) & (following <= 0.35), "Reduce Acquisition Spend")
        .otherwise(DEFAULT_ACTION)
    )


def by_action(action: Column, item: int) -> Column:
    """A rate of the action's policy; unknown actions have the default's."""
    out = F.lit(POLICIES[DEFAULT_ACTION][item])
    for name, policy in POLICIES.items():
        out = F.when(action == name, F.lit(policy[item])).otherwise(out)
    return out


def expected_uplift(action: Column, ltv: Column, cac: Column, churn: Column, following: Column) -> Column:
    base = F.when(action == "Retention Campaign", ltv * churn).when(action == "Reduce Acquisition Spend", cac).otherwise(ltv * following)
    return base * by_action(action, 0)


def action_cost(action: Column, ltv: Column, cac: Column) -> Column:
    return F.when(by_action(action, 2) == "cac", cac).otherwise(ltv) * by_action(action, 1)


def require(df: DataFrame, columns: set[str], table: str) -> DataFrame:
    if missing := columns - set(df.columns):
        raise ValueError(f"{table} lacks columns: {sorted(missing)}")
    return df
