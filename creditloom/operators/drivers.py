"""Correlation of features with the outcome and with each other."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.fixed import TARGET, TOP_DRIVERS
from creditloom.functions.features import as_double
from creditloom.functions.labels import direction
from creditloom.operators.features import add_derived_features, fix_sentinel, numeric_columns


def _pearson(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of ``x`` and ``y`` per key over complete pairs; NULL for a constant side."""
    complete = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    spread = F.sqrt(F.col("vx")) * F.sqrt(F.col("vy"))
    return (
        complete.groupBy(*keys)
        .agg(F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
        .select(*keys, F.try_divide(F.col("c"), spread).alias("r"))
    )


def _as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[as_double(c).alias(c) for c in columns])


def target_correlation(
    df: DataFrame, target: str = TARGET, k: int = TOP_DRIVERS, sentinel_fixed: bool = False
) -> DataFrame:
    """The ``k`` numeric columns most correlated with the outcome, strongest first.

    Derived features are added first. Equal strengths (an age in days and in
    years) are ranked by name after rounding away float noise. The unemployed
    sentinel takes part unless ``sentinel_fixed``.
    """
    full = add_derived_features(fix_sentinel(df) if sentinel_fixed else df)
    features = [c for c in numeric_columns(full) if c != target]
    pairs = _as_doubles(full, [target, *features]).withColumnRenamed(target, "y")
    r = F.col("r")
    return (
        _pearson(pairs.unpivot("y", features, "feature", "x"), ["feature"])
        .where(r.isNotNull())
        .select("feature", r.alias("correlation"), F.abs(r).alias("abs_correlation"), direction(r).alias("direction"))
        .orderBy(F.desc(F.round("abs_correlation", 9)), "feature")
        .limit(k)
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix ``(a, b, r)`` over all ordered pairs; the diagonal is 1.

    The upper triangle is computed in one scan and mirrored. A constant column
    has no correlation, not even with itself.
    """
    columns = list(columns)

    wanted = [*combinations(columns, 2), *((c, c) for c in columns)]
    # The data carries a pair number; names are looked up in the small result.
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y"))
            for i, (a, b) in enumerate(wanted)
        ]
    )
    upper = _pearson(_as_doubles(df, columns).select(F.inline(pairs)), ["pair"])
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in wanted])
    named = upper.select(F.get(names, F.col("pair")).alias("k"), "r").select("k.a", "k.b", "r")
    same = F.col("a") == F.col("b")
    both_ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    exact = F.when(same & F.col("r").isNotNull(), F.lit(1.0)).otherwise(F.col("r"))
    mirrored = F.explode(F.when(same, F.array(F.struct("a", "b"))).otherwise(both_ways))
    return named.select(mirrored.alias("k"), exact.alias("r")).select("k.a", "k.b", "r")


def pivot_matrix(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column, in the given order."""
    position = F
    for i, c in enumerate(columns):
        position = position.when(F.col("a") == c, i)
    return matrix.groupBy("a").pivot("b", list(columns)).agg(F.first("r")).orderBy(position)
