"""Derived credit features as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.fixed import SCORES

DAYS_PER_YEAR = 365.0


def age_years(days: str = "DAYS_BIRTH") -> Column:
    """Days are counted backwards from the application, so ages come out positive."""
    return F.col(days) / F.lit(-DAYS_PER_YEAR)


def whole_age_years(days: str = "DAYS_BIRTH") -> Column:
    """Completed years, as integer division of the stored days gives them."""
    return F.expr(f"`{days}` DIV -365")


def employed_years(days: str = "DAYS_EMPLOYED") -> Column:
    """Zero for the unemployed sentinel, for zero days and for missing values."""
    d = F.col(days)
    return F.when(d < 0, d / F.lit(-DAYS_PER_YEAR)).otherwise(F.lit(0.0))


def without_sentinel(days: str = "DAYS_EMPLOYED") -> Column:
    """Positive day counts (the unemployed sentinel) become zero; NULL stays NULL."""
    d = F.col(days)
    return F.when(d > 0, F.lit(0)).otherwise(d)


def ratio_plus_one(numerator: str, denominator: str) -> Column:
    """``a / (b + 1)``, NULL where the divisor is zero."""
    return F.try_divide(F.col(numerator), F.col(denominator) + F.lit(1.0))


def mean_present(columns: Iterable[str] = SCORES) -> Column:
    """Mean of the values that are present, NULL when none is."""
    cols = [F.col(c) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    present = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(total, present)


def derived(columns: Iterable[str]) -> dict[str, Column]:
    """The derived features whose inputs are among ``columns``."""
    have = set(columns)
    out: dict[str, Column] = {}
    if "DAYS_BIRTH" in have:
        out["AGE_YEARS"] = age_years()
    if "DAYS_EMPLOYED" in have:
        out["EMPLOYED_YEARS"] = employed_years()
    for name, top, bottom in (
        ("DEBT_TO_INCOME", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
        ("ANNUITY_TO_INCOME", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        ("CREDIT_UTIL", "AMT_ANNUITY", "AMT_CREDIT"),
    ):
        if {top, bottom} <= have:
            out[name] = ratio_plus_one(top, bottom)
    scores = [c for c in SCORES if c in have]
    if scores:
        out["EXT_SOURCE_AVG"] = mean_present(scores)
    return out


def as_double(column: str) -> Column:
    """The column as a double; NaN counts as missing everywhere."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)
