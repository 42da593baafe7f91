"""Portfolio KPIs, default rates by segment and borrower joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.fixed import ID, MIN_SEGMENT_ROWS, TARGET, TOP_SEGMENTS
from creditloom.functions import labels
from creditloom.functions.features import ratio_plus_one


def rate_pct(defaults: Column, rows: Column) -> Column:
    """Rows with an unknown outcome stay in the denominator."""
    return F.round(F.try_divide(F.lit(100.0) * defaults, rows), 2)


def _rate(target: str = TARGET) -> Column:
    return rate_pct(F.sum(target), F.count(F.lit(1)))


def kpi_aggregates(target: str = TARGET) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_borrowers"),
        _rate(target).alias("default_rate_pct"),
        F.round(F.avg("AMT_INCOME_TOTAL"), 2).alias("avg_income"),
        F.round(F.avg("AMT_CREDIT"), 2).alias("avg_credit"),
        F.round(F.avg("AMT_ANNUITY"), 2).alias("avg_annuity"),
        F.round(F.avg(ratio_plus_one("AMT_CREDIT", "AMT_INCOME_TOTAL")), 2).alias("avg_loan_to_income"),
    ]


def portfolio_kpis(df: DataFrame) -> DataFrame:
    return df.agg(*kpi_aggregates())


def portfolio_default_rate(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_borrowers"),
        F.sum(target).alias("total_defaults"),
        _rate(target).alias("default_rate_pct"),
    )


def default_rate_by(
    df: DataFrame, key: str | Column, target: str = TARGET, descending: bool = False
) -> DataFrame:
    """Rows and default rate per value of ``key``; optionally highest rate first."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"), _rate(target).alias("default_rate"))
    return out.orderBy(F.desc("default_rate"), out.columns[0]) if descending else out


def default_rate_by_gender(df: DataFrame) -> DataFrame:
    return default_rate_by(df.where(labels.known_gender()), "CODE_GENDER")


def default_rate_by_income_type(df: DataFrame) -> DataFrame:
    return default_rate_by(df, "NAME_INCOME_TYPE", descending=True)


def default_rate_by_contract_type(df: DataFrame) -> DataFrame:
    return default_rate_by(df, "NAME_CONTRACT_TYPE")


def default_rate_by_age_group(df: DataFrame, target: str = TARGET) -> DataFrame:
    return (
        df.groupBy(labels.age_group().alias("age_group"))
        .agg(F.count(F.lit(1)).alias("borrower_count"), _rate(target).alias("default_rate_pct"))
        .orderBy("age_group")
    )


def top_segments(
    df: DataFrame,
    key: str = "NAME_INCOME_TYPE",
    min_count: int = MIN_SEGMENT_ROWS,
    k: int = TOP_SEGMENTS,
    target: str = TARGET,
) -> DataFrame:
    """The ``k`` segments with the highest default rate among those above ``min_count`` rows."""
    return (
        df.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("borrower_count"),
            F.round(F.avg("AMT_INCOME_TOTAL"), 0).alias("avg_income"),
            _rate(target).alias("default_rate_pct"),
        )
        .where(F.col("borrower_count") > min_count)
        .orderBy(F.desc("default_rate_pct"), key)
        .limit(k)
    )


def distinct_count(df: DataFrame, column: str = ID, approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(counter(F.col(column)).alias("distinct_count"))


def share_of_total(df: DataFrame, key: str = "NAME_CONTRACT_TYPE") -> DataFrame:
    """Rows per value and their percentage of all rows (the window sees one row per value)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    share = F.lit(100.0) * F.col("count") / F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share_pct", F.round(share, 2))


def class_balance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Positives, negatives, default rate and the weight that balances the positives."""
    labelled = df.where(F.col(target).isNotNull())
    rate = F.avg(F.col(target).cast("double"))
    return labelled.agg(
        F.count_if(F.col(target) == 0).alias("repaid"),
        F.count_if(F.col(target) == 1).alias("defaulted"),
        F.round(rate, 6).alias("default_rate"),
        F.round(F.try_divide(F.lit(1.0) - rate, rate), 6).alias("scale_pos_weight"),
    )


def overview(df: DataFrame, keys: Sequence[str] = ("CODE_GENDER", "NAME_INCOME_TYPE", "NAME_CONTRACT_TYPE")) -> DataFrame:
    """KPIs of the whole portfolio and of every segment of each key, in one scan.

    Rows are ``(dimension, segment, kpis...)``; the total has dimension 'all'.
    """
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("gid"), *kpi_aggregates()
    )
    # grouping_id has one bit per key, 0 when the key is part of the set.
    everything = (1 << len(keys)) - 1
    dimension = F.when(F.col("gid") == everything, "all")
    segment = F.when(F.col("gid") == everything, "all")
    for i, k in enumerate(keys):
        alone = everything ^ (1 << (len(keys) - 1 - i))
        dimension = dimension.when(F.col("gid") == alone, k)
        segment = segment.when(F.col("gid") == alone, F.col(k))
    measures = [c for c in grouped.columns if c not in {*keys, "gid"}]
    return grouped.select(dimension.alias("dimension"), segment.alias("segment"), *measures)


def bureau_loans_by_gender(applications: DataFrame, bureau: DataFrame) -> DataFrame:
    """Borrowers, mean number of bureau loans and default rate per known gender.

    Loans are counted per borrower before the join, so it cannot fan out and a
    borrower with very many loans is one row. Borrowers without loans do not
    enter the mean.
    """
    loans = bureau.groupBy(ID).agg(F.count(F.lit(1)).alias("loan_count"))
    return (
        applications.where(labels.known_gender())
        .select(ID, TARGET, "CODE_GENDER")
        .join(loans, ID, "left")
        .groupBy("CODE_GENDER")
        .agg(
            F.count_distinct(F.col(ID)).alias("borrowers"),
            F.round(F.avg("loan_count"), 1).alias("avg_bureau_loans"),
            _rate().alias("default_rate_pct"),
        )
    )


def previous_status_analysis(applications: DataFrame, previous: DataFrame) -> DataFrame:
    """Counts, mean income and default rate per status of previous applications.

    Rates weigh each borrower by its previous applications, as the plain 1:N
    join does. Counting per (borrower, status) first keeps that weight as a
    number: a borrower with a huge history joins as a handful of rows.
    """
    weights = previous.groupBy(ID, "NAME_CONTRACT_STATUS").agg(F.count(F.lit(1)).alias("n"))
    income = F.col("AMT_INCOME_TOTAL")
    weighted_income = F.try_divide(
        F.sum(income * F.col("n")), F.sum(F.when(income.isNotNull(), F.col("n")))
    )
    return (
        applications.select(ID, TARGET, "AMT_INCOME_TOTAL")
        .join(weights, ID)
        .groupBy("NAME_CONTRACT_STATUS")
        .agg(
            F.sum("n").alias("count"),
            F.round(weighted_income, 0).alias("avg_income"),
            rate_pct(F.sum(F.col(TARGET) * F.col("n")), F.sum("n")).alias("default_rate_pct"),
        )
        .orderBy(F.desc("default_rate_pct"), "NAME_CONTRACT_STATUS")
    )


def bureau_count_per_borrower(applications: DataFrame, bureau: DataFrame) -> DataFrame:
    """Number of bureau records per borrower, 0 for none."""
    records = bureau.groupBy(ID).agg(F.count("SK_ID_BUREAU").alias("records"))
    return (
        applications.select(ID, TARGET)
        .join(records, ID, "left")
        .groupBy(ID, TARGET)
        .agg(F.sum(F.coalesce("records", F.lit(0))).alias("bureau_count"))
    )
