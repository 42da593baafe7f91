"""Projections and filters that feed charts, clustering and training.

None caps its rows; use ``sampling.deterministic_cap`` where a cap is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.fixed import DRIVERS, ID, SCORES, TARGET

BORROWER_COLUMNS = (
    ID,
    TARGET,
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    *SCORES,
)


def clustering_frame(df: DataFrame) -> DataFrame:
    return df.where(F.col("EXT_SOURCE_2").isNotNull()).select(*BORROWER_COLUMNS)


def training_frame(df: DataFrame) -> DataFrame:
    return df.where(F.col(TARGET).isNotNull()).select(*BORROWER_COLUMNS)


def driver_frame(df: DataFrame) -> DataFrame:
    return df.select(TARGET, *DRIVERS)


def capped_values(df: DataFrame, column: str, cap: float) -> DataFrame:
    """``(column, TARGET)`` up to the cap; missing values drop out."""
    return df.where(F.col(column) <= cap).select(column, TARGET)


def feature_by_target(df: DataFrame, feature: str) -> DataFrame:
    """Known values of one of the studied features with the outcome."""
    if feature not in DRIVERS:
        raise ValueError(f"Feature '{feature}' not allowed")
    return df.where(F.col(feature).isNotNull()).select(TARGET, feature)


def explainable_rows(df: DataFrame) -> DataFrame:
    """Borrowers with all three bureau scores."""
    return df.dropna(subset=list(SCORES))


def inputs_from_applications(df: DataFrame) -> DataFrame:
    """Applications in the units of the scoring form: years instead of days."""
    from creditloom.functions.features import age_years, employed_years

    return df.select(
        ID,
        F.col("AMT_INCOME_TOTAL").alias("income"),
        F.col("AMT_CREDIT").alias("loan_amount"),
        F.col("AMT_ANNUITY").alias("annuity"),
        age_years().alias("age"),
        employed_years().alias("employed_years"),
        *[F.col(c).alias(c.lower()) for c in SCORES],
    )


def application_inputs(inputs: DataFrame) -> DataFrame:
    """Model columns from form inputs; any other input column is kept."""

    def days(years: str) -> Column:
        return F.col(years) * F.lit(-365)

    def per_income(amount: str) -> Column:
        return F.try_divide(F.col(amount), F.col("income") + F.lit(1.0))

    form = ("income", "loan_amount", "annuity", "age", "employed_years", *[c.lower() for c in SCORES])
    return inputs.select(
        *[c for c in inputs.columns if c not in form],
        F.col("income").alias("AMT_INCOME_TOTAL"),
        F.col("loan_amount").alias("AMT_CREDIT"),
        F.col("annuity").alias("AMT_ANNUITY"),
        days("age").alias("DAYS_BIRTH"),
        days("employed_years").alias("DAYS_EMPLOYED"),
        *[F.col(c.lower()).alias(c) for c in SCORES],
        per_income("loan_amount").alias("DEBT_TO_INCOME"),
        per_income("annuity").alias("ANNUITY_TO_INCOME"),
    )
