"""Histograms, densities, box statistics, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.fixed import HISTOGRAM_BINS
from creditloom.functions.features import as_double
from creditloom.operators.features import numeric_columns
from creditloom.operators.ranking import quantiles


def histogram(df: DataFrame, column: str, by: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per equal-width bin between the extremes of all groups together.

    Rows are ``([by], bin, bin_start, bin_end, count)``, only non-empty bins.
    """
    ids = [by] if by else []
    values = df.select(*ids, as_double(column).alias("x")).where(F.col("x").isNotNull())
    edges = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_no = F.when(
        F.col("hi") > F.col("lo"),
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)),
    ).otherwise(F.lit(0).cast("long"))
    return (
        values.crossJoin(F.broadcast(edges))
        .groupBy(*ids, bin_no.alias("bin"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            *ids,
            "bin",
            (F.col("lo") + width * F.col("bin")).alias("bin_start"),
            (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"),
            "count",
        )
    )


def density_histogram(df: DataFrame, column: str, by: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The histogram with ``density``: areas of each group add up to one."""
    width = F.col("bin_end") - F.col("bin_start")
    in_group = F.sum("count").over(Window.partitionBy(by))
    density = F.try_divide(F.col("count").cast("double"), in_group * width)
    return histogram(df, column, by, bins).withColumn("density", density)


def box_stats(df: DataFrame, value: str, by: str, groups: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outliers per group."""
    q = quantiles(df, {value: (0.25, 0.5, 0.75)}, by, groups, accuracy)
    quartiles = q.groupBy(by).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    x = as_double(value)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    return (
        df.where(x.isNotNull())
        .join(F.broadcast(quartiles), by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(x >= low, x)).alias("whisker_low"),
            F.max(F.when(x <= high, x)).alias("whisker_high"),
            F.count_if((x < low) | (x > high)).alias("outliers"),
        )
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the numeric columns.

    Empty when there is no numeric column or fewer than two rows.
    """
    columns = list(columns or numeric_columns(df))
    if not columns:
        spark = df.sparkSession
        return spark.createDataFrame(
            [],
            "column string, count bigint, mean double, std double, min double, "
            "p25 double, p50 double, p75 double, max double",
        )
    wide = df.select(*[as_double(c).alias(c) for c in columns])
    moments = (
        wide.unpivot([], columns, "column", "x")
        .groupBy("column")
        .agg(
            # Every row of the frame gives one row for each column, missing or not.
            F.count(F.lit(1)).alias("rows"),
            F.count("x").alias("count"),
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("std"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
        )
    )
    q = quantiles(wide, {c: (0.25, 0.5, 0.75) for c in columns}, accuracy=accuracy)
    quartiles = q.groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    )
    return (
        moments.join(F.broadcast(quartiles), "column", "left")
        .where(F.col("rows") > 1)
        .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    )
