"""Schemas of the three loan tables, with a comment on every column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _table(*columns: tuple[str, T.DataType, str]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True, {"comment": c}) for n, t, c in columns])


# Tables, columns and their meaning.
SCHEMAS: dict[str, T.StructType] = {
    "applications": _table(
        ("SK_ID_CURR", _LONG, "Unique borrower ID (primary key)"),
        ("TARGET", _INT, "1 = defaulted, 0 = repaid"),
        ("AMT_INCOME_TOTAL", _DOUBLE, "Annual income"),
        ("AMT_CREDIT", _DOUBLE, "Loan amount"),
        ("AMT_ANNUITY", _DOUBLE, "Annual repayment"),
        ("AMT_GOODS_PRICE", _DOUBLE, "Price of goods financed"),
        ("DAYS_BIRTH", _INT, "Age in days (negative)"),
        ("DAYS_EMPLOYED", _INT, "Employment duration (negative, 365243 = unemployed)"),
        ("NAME_CONTRACT_TYPE", _STRING, "Cash loans / Revolving loans"),
        ("CODE_GENDER", _STRING, "M / F / XNA"),
        ("FLAG_OWN_CAR", _STRING, "Y / N"),
        ("FLAG_OWN_REALTY", _STRING, "Y / N"),
        ("NAME_INCOME_TYPE", _STRING, "Working, Pensioner, etc."),
        ("NAME_EDUCATION_TYPE", _STRING, "Education level"),
        ("NAME_FAMILY_STATUS", _STRING, "Marital status"),
        ("NAME_HOUSING_TYPE", _STRING, "Housing type"),
        ("OCCUPATION_TYPE", _STRING, "Job type"),
        ("EXT_SOURCE_1", _DOUBLE, "External bureau score (0-1, higher = better)"),
        ("EXT_SOURCE_2", _DOUBLE, "External bureau score (0-1, higher = better)"),
        ("EXT_SOURCE_3", _DOUBLE, "External bureau score (0-1, higher = better)"),
        ("REGION_POPULATION_RELATIVE", _DOUBLE, "Relative population of the home region"),
        ("OBS_30_CNT_SOCIAL_CIRCLE", _DOUBLE, "Observed 30 days past due in the social circle"),
        ("DEF_30_CNT_SOCIAL_CIRCLE", _DOUBLE, "Defaulted 30 days past due in the social circle"),
        ("AMT_REQ_CREDIT_BUREAU_YEAR", _DOUBLE, "Bureau enquiries in the last year"),
    ),
    "bureau": _table(
        ("SK_ID_CURR", _LONG, "FK to applications"),
        ("SK_ID_BUREAU", _LONG, "Unique bureau record ID"),
        ("CREDIT_ACTIVE", _STRING, "Active / Closed / Sold / Bad debt"),
        ("CREDIT_TYPE", _STRING, "Type of external credit"),
        ("AMT_CREDIT_SUM", _DOUBLE, "Credit amount"),
        ("AMT_CREDIT_SUM_DEBT", _DOUBLE, "Current debt outstanding"),
        ("AMT_CREDIT_SUM_OVERDUE", _DOUBLE, "Overdue amount"),
        ("CREDIT_DAY_OVERDUE", _INT, "Days overdue"),
    ),
    "previous_application": _table(
        ("SK_ID_CURR", _LONG, "FK to applications"),
        ("SK_ID_PREV", _LONG, "Unique previous app ID"),
        ("NAME_CONTRACT_STATUS", _STRING, "Approved / Refused / Canceled / Unused offer"),
        ("AMT_APPLICATION", _DOUBLE, "Requested amount"),
        ("AMT_CREDIT", _DOUBLE, "Approved credit amount"),
        ("NAME_CONTRACT_TYPE", _STRING, "Type of previous loan"),
    ),
}

# File name of each table in a source folder.
CSV_FILES = {
    "applications": "application_train.csv",
    "bureau": "bureau.csv",
    "previous_application": "previous_application.csv",
}
DESCRIPTION_ENCODING = "ISO-8859-1"


def with_comments(df: DataFrame, table: str) -> DataFrame:
    """Attach the documented comments to the columns that have one."""
    known = {f.name: f.metadata for f in SCHEMAS[table].fields}
    return df.select(*[F.col(c).alias(c, metadata=known[c]) if c in known else F.col(c) for c in df.columns])


def schema_reference(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, position, column_name, data_type, comment, row_count)`` of the loaded tables."""
    listed = [
        (name, i, f.name, f.dataType.simpleString(), f.metadata.get("comment", ""))
        for name, df in tables.items()
        for i, f in enumerate(with_comments(df, name).schema.fields)
    ]
    columns = spark.createDataFrame(
        listed, "table_name string, position int, column_name string, data_type string, comment string"
    )
    return columns.join(F.broadcast(verify_counts(tables)), "table_name")


def verify_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)``, one row per table."""
    out = None
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = counted if out is None else out.unionByName(counted)
    return out
