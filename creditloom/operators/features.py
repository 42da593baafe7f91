"""Feature engineering over whole frames: derive, impute, clip."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.fixed import (
    CLIP_BOUNDS,
    CLIPPED_FEATURES,
    CLUSTER_FEATURES,
    ID,
    MODEL_FEATURES,
    SCORES,
    TARGET,
)
from creditloom.functions.features import as_double, derived, without_sentinel
from creditloom.operators.ranking import quantile_values


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def add_derived_features(df: DataFrame) -> DataFrame:
    """Ages, ratios and the mean score, each where its inputs exist."""
    return df.withColumns(derived(df.columns))


def fix_sentinel(df: DataFrame) -> DataFrame:
    return df.withColumn("DAYS_EMPLOYED", without_sentinel()) if "DAYS_EMPLOYED" in df.columns else df


def medians(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> dict[str, float | None]:
    """The median of each column, computed now."""
    found = quantile_values(df, {c: (0.5,) for c in columns}, accuracy)
    return {c: found[c][0.5] for c in columns}


def _fill_zeros(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    zeros = [c for c in numeric_columns(df) if c not in SCORES and c not in exclude]
    return df.fillna(0, subset=zeros) if zeros else df


def _clipped(column: str, lo: float | None, hi: float | None) -> Column:
    x = F.col(column)
    if lo is None:
        return x
    # The bare bounds functions would turn a NULL into a bound.
    return F.when(x.isNotNull(), F.greatest(F.least(x.cast("double"), F.lit(hi)), F.lit(lo)))


def impute_nulls(
    df: DataFrame, exclude: Sequence[str] = (ID, TARGET), accuracy: int | None = None
) -> DataFrame:
    """Scores get their median, every other numeric column gets zero.

    Identifiers and the outcome are left alone unless ``exclude`` says otherwise.
    """
    scores = [c for c in SCORES if c in df.columns and c not in exclude]
    known = {c: m for c, m in medians(df, scores, accuracy).items() if m is not None} if scores else {}
    filled = _fill_zeros(df, exclude)
    return filled.fillna(known) if known else filled


def clip_outliers(
    df: DataFrame,
    columns: str | Sequence[str],
    lower: float = CLIP_BOUNDS[0],
    upper: float = CLIP_BOUNDS[1],
    accuracy: int | None = None,
) -> DataFrame:
    """Winsorise to quantiles of the column itself; NULL stays NULL."""
    asked = [columns] if isinstance(columns, str) else list(columns)
    present = [c for c in asked if c in df.columns]
    if not present:
        return df
    bounds = quantile_values(df, {c: (lower, upper) for c in present}, accuracy)
    return df.withColumns({c: _clipped(c, bounds[c][lower], bounds[c][upper]) for c in present})


def prepare_clustering_data(df: DataFrame, accuracy: int | None = None) -> tuple[DataFrame, list[str]]:
    """Derived, imputed and clipped frame with the names of the cluster features.

    The medians and the clip bounds come from the same passes over the data:
    neither depends on the other.
    """
    full = _fill_zeros(add_derived_features(df), (ID, TARGET))
    lower, upper = CLIP_BOUNDS
    scores = [c for c in SCORES if c in full.columns]
    ratios = [c for c in CLIPPED_FEATURES if c in full.columns]
    wanted = {c: (0.5,) for c in scores} | {c: (lower, upper) for c in ratios}
    found = quantile_values(full, wanted, accuracy) if wanted else {}
    known = {c: found[c][0.5] for c in scores if found[c][0.5] is not None}
    filled = full.fillna(known) if known else full
    out = filled.withColumns({c: _clipped(c, found[c][lower], found[c][upper]) for c in ratios})
    return out, [c for c in CLUSTER_FEATURES if c in out.columns]


def prepare_model_features(
    df: DataFrame, impute: bool = True, accuracy: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Frame for the default model with the names of its features.

    Training passes ``impute=False``: there, medians come from the training
    rows only.
    """
    full = add_derived_features(df)
    full = fix_sentinel(impute_nulls(full, accuracy=accuracy) if impute else full)
    return full, [c for c in MODEL_FEATURES if c in full.columns]


def scale(df: DataFrame, moments: Mapping[str, tuple[float, float]], prefix: str = "z_") -> DataFrame:
    """Standardise with given (mean, deviation); a zero deviation counts as one."""
    return df.withColumns(
        {f"{prefix}{c}": (F.col(c) - F.lit(float(m))) / F.lit(float(s) or 1.0) for c, (m, s) in moments.items()}
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, as rows ``(column, mean, std)``."""
    return (
        df.select(*[as_double(c).alias(c) for c in columns])
        .unpivot([], list(columns), "column", "x")
        .groupBy("column")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    )


def collect_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The moments as numbers: two per column, for building a scaler."""
    return {r["column"]: (r["mean"], r["std"]) for r in moments(df, columns).collect()}
