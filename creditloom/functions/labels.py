"""Buckets, bands and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.fixed import (
    AGREEMENT,
    AGREEMENT_LIMITS,
    BAND_LIMITS,
    DEFAULT_THRESHOLD_PCT,
    RISK_TIERS,
    TARGET,
    UNKNOWN_GENDER,
)

# Upper age limits and their labels.
AGE_LIMITS = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"))
OLDEST = "55+"


def age_group(days: str = "DAYS_BIRTH") -> Column:
    """Age bucket; a missing age falls into the last one, as in a CASE with ELSE."""
    years = F.col(days) / F.lit(-365.0)
    out = F
    for limit, label in AGE_LIMITS:
        out = out.when(years < limit, label)
    return out.otherwise(OLDEST)


def status(target: str = TARGET) -> Column:
    """Repaid / Defaulted, NULL for anything else."""
    return F.when(F.col(target) == 0, "Repaid").when(F.col(target) == 1, "Defaulted")


def known_gender(gender: str = "CODE_GENDER") -> Column:
    """Predicate that drops the unknown sentinel and, by three-valued logic, NULL."""
    return F.col(gender) != UNKNOWN_GENDER


def threshold_flag(rate_pct: Column, limit: float = DEFAULT_THRESHOLD_PCT) -> Column:
    return F.concat(
        F.when(rate_pct > limit, "Above").otherwise("Below"), F.lit(f" {limit:g}% threshold")
    )


def risk_band(p: Column) -> Column:
    """Low / Medium / High by default probability; an unknown probability has no band."""
    low, high = BAND_LIMITS
    return (
        F.when(p < low, RISK_TIERS[0])
        .when(p < high, RISK_TIERS[1])
        .when(p >= high, RISK_TIERS[2])
    )


def tier_rank(tier: Column) -> Column:
    """Sort key that keeps the tiers in their business order."""
    out = F
    for i, name in enumerate(RISK_TIERS):
        out = out.when(tier == name, i)
    return out.otherwise(len(RISK_TIERS))


def agreement(difference_points: Column) -> Column:
    """How far two models are apart, in percentage points."""
    moderate, significant = AGREEMENT_LIMITS
    return (
        F.when(difference_points > significant, AGREEMENT[2])
        .when(difference_points > moderate, AGREEMENT[1])
        .when(difference_points.isNotNull(), AGREEMENT[0])
    )


def direction(r: Column) -> Column:
    return F.when(r > 0, "Increases Default").otherwise("Decreases Default")


def gauge(p: Column) -> Column:
    """Probability cut at one; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(p > 1.0, F.lit(1.0)).otherwise(p)
