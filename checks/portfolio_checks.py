"""Portfolio, join, frame, sampling and ad hoc SQL queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.binding import COLUMNS, Tables
from checks.registry import query, rounded
from checks.sql import BORROWER, RATE, cte, shuffled, union
from creditloom import fixed as X
from creditloom.functions import features, labels
from creditloom.operators import adhoc, frames, portfolio, sampling
from creditloom.plans import sql_catalogue
from creditloom.session import scratch_path
from creditloom.sources import csv, schemas
from creditloom.sources.tables import load_manifest

KPIS = f"""count(*) AS total_borrowers, {RATE} AS default_rate_pct, round(avg(AMT_INCOME_TOTAL), 2) AS avg_income,
  round(avg(AMT_CREDIT), 2) AS avg_credit, round(avg(AMT_ANNUITY), 2) AS avg_annuity,
  round(avg(AMT_CREDIT / (AMT_INCOME_TOTAL + 1e0)), 2) AS avg_loan_to_income"""
AGE_GROUP = """CASE WHEN DAYS_BIRTH / -365e0 < 25 THEN '18-24' WHEN DAYS_BIRTH / -365e0 < 35 THEN '25-34'
  WHEN DAYS_BIRTH / -365e0 < 45 THEN '35-44' WHEN DAYS_BIRTH / -365e0 < 55 THEN '45-54' ELSE '55+' END"""


# Portfolio aggregates

@query("portfolio_kpis", f"SELECT {KPIS} FROM applications")
def _(t: Tables) -> DataFrame:
    return portfolio.portfolio_kpis(t.applications)


@query(
    "default_rate_by_gender",
    f"""SELECT CODE_GENDER, count(*) AS count, {RATE} AS default_rate FROM applications
WHERE CODE_GENDER <> 'XNA' GROUP BY CODE_GENDER""",
)
def _(t):
    return portfolio.default_rate_by_gender(t.applications)


@query(
    "default_rate_by_income_type",
    f"SELECT NAME_INCOME_TYPE, count(*) AS count, {RATE} AS default_rate FROM applications GROUP BY 1",
)
def _(t):
    return portfolio.default_rate_by_income_type(t.applications)


@query(
    "default_rate_by_contract_type",
    f"SELECT NAME_CONTRACT_TYPE, count(*) AS count, {RATE} AS default_rate FROM applications GROUP BY 1",
)
def _(t):
    return portfolio.default_rate_by_contract_type(t.applications)


@query(
    "portfolio_default_rate",
    f"""SELECT count(*) AS total_borrowers, CAST(sum(TARGET) AS BIGINT) AS total_defaults,
  {RATE} AS default_rate_pct FROM applications""",
)
def _(t):
    return portfolio.portfolio_default_rate(t.applications)


@query(
    "top_income_types",
    f"""SELECT NAME_INCOME_TYPE, count(*) AS borrower_count, round(avg(AMT_INCOME_TOTAL), 0) AS avg_income,
  {RATE} AS default_rate_pct FROM applications GROUP BY 1 HAVING count(*) > 100
ORDER BY default_rate_pct DESC, NAME_INCOME_TYPE LIMIT 10""",
)
def _(t):
    return portfolio.top_segments(t.applications)


@query("distinct_borrowers", "SELECT count(DISTINCT SK_ID_CURR) AS distinct_count FROM bureau")
def _(t):
    return portfolio.distinct_count(t.bureau)


@query(
    "contract_share",
    """SELECT NAME_CONTRACT_TYPE, count(*) AS count,
  round(100e0 * count(*) / sum(count(*)) OVER (), 2) AS share_pct FROM applications GROUP BY 1""",
)
def _(t):
    return portfolio.share_of_total(t.applications)


@query(
    "class_balance",
    """SELECT count(*) FILTER (WHERE TARGET = 0) AS repaid, count(*) FILTER (WHERE TARGET = 1) AS defaulted,
  round(avg(TARGET), 6) AS default_rate, round((1e0 - avg(TARGET)) / avg(TARGET), 6) AS scale_pos_weight
FROM applications WHERE TARGET IS NOT NULL""",
)
def _(t):
    return portfolio.class_balance(t.applications)


@query(
    "portfolio_overview",
    union(
        [f"SELECT 'all' AS dimension, 'all' AS segment, {KPIS} FROM applications"]
        + [
            f"SELECT '{k}' AS dimension, {k} AS segment, {KPIS} FROM applications GROUP BY {k}"
            for k in ("CODE_GENDER", "NAME_INCOME_TYPE", "NAME_CONTRACT_TYPE")
        ]
    ),
)
def _(t):
    return portfolio.overview(t.applications)


@query(
    "segment_threshold_flags",
    f"""SELECT NAME_INCOME_TYPE, default_rate,
  CASE WHEN default_rate > 8 THEN 'Above 8% threshold' ELSE 'Below 8% threshold' END AS flag
FROM (SELECT NAME_INCOME_TYPE, {RATE} AS default_rate FROM applications GROUP BY 1)""",
)
def _(t):
    rates = portfolio.default_rate_by_income_type(t.applications)
    return rates.select("NAME_INCOME_TYPE", "default_rate", labels.threshold_flag(F.col("default_rate")).alias("flag"))


@query(
    "age_groups",
    f"SELECT {AGE_GROUP} AS age_group, count(*) AS borrower_count, {RATE} AS default_rate_pct FROM applications GROUP BY 1",
)
def _(t):
    return portfolio.default_rate_by_age_group(t.applications)


# Joins

@query(
    "bureau_loans_by_gender",
    f"""SELECT CODE_GENDER, count(DISTINCT a.SK_ID_CURR) AS borrowers, round(avg(n), 1) AS avg_bureau_loans,
  {RATE} AS default_rate_pct
FROM applications a LEFT JOIN (SELECT SK_ID_CURR, count(*) AS n FROM bureau GROUP BY 1) b USING (SK_ID_CURR)
WHERE CODE_GENDER <> 'XNA' GROUP BY CODE_GENDER""",
)
def _(t):
    return portfolio.bureau_loans_by_gender(t.applications, t.bureau)


@query(
    "previous_status_analysis",
    f"""SELECT NAME_CONTRACT_STATUS, count(*) AS count, round(avg(AMT_INCOME_TOTAL), 0) AS avg_income,
  {RATE} AS default_rate_pct
FROM applications a JOIN previous_application p ON a.SK_ID_CURR = p.SK_ID_CURR GROUP BY 1""",
)
def _(t):
    return rounded(
        portfolio.previous_status_analysis(t.applications, t.previous_application), 2, "default_rate_pct"
    )


@query(
    "bureau_count_per_borrower",
    """SELECT a.SK_ID_CURR, a.TARGET, count(b.SK_ID_BUREAU) AS bureau_count
FROM applications a LEFT JOIN bureau b ON a.SK_ID_CURR = b.SK_ID_CURR GROUP BY 1, 2""",
)
def _(t):
    return portfolio.bureau_count_per_borrower(t.applications, t.bureau)


# Projections and filters

@query("clustering_frame", f"SELECT {BORROWER} FROM applications WHERE EXT_SOURCE_2 IS NOT NULL")
def _(t):
    return frames.clustering_frame(t.applications)


@query("driver_frame", f"SELECT TARGET, {', '.join(X.DRIVERS)} FROM applications")
def _(t):
    return frames.driver_frame(t.applications)


@query("training_frame", f"SELECT {BORROWER} FROM applications WHERE TARGET IS NOT NULL")
def _(t):
    return frames.training_frame(t.applications)


@query("income_values_capped", "SELECT AMT_INCOME_TOTAL, TARGET FROM applications WHERE AMT_INCOME_TOTAL <= 1000000")
def _(t):
    return frames.capped_values(t.applications, "AMT_INCOME_TOTAL", X.INCOME_CAP)


@query("credit_values_capped", "SELECT AMT_CREDIT, TARGET FROM applications WHERE AMT_CREDIT <= 2000000")
def _(t):
    return frames.capped_values(t.applications, "AMT_CREDIT", X.CREDIT_CAP)


@query("feature_by_target", "SELECT TARGET, EXT_SOURCE_2 FROM applications WHERE EXT_SOURCE_2 IS NOT NULL")
def _(t):
    return frames.feature_by_target(t.applications, "EXT_SOURCE_2")


@query(
    "explainable_rows",
    """SELECT SK_ID_CURR, EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3 FROM applications
WHERE EXT_SOURCE_1 IS NOT NULL AND EXT_SOURCE_2 IS NOT NULL AND EXT_SOURCE_3 IS NOT NULL""",
)
def _(t):
    return frames.explainable_rows(t.applications).select(X.ID, *X.SCORES)


@query("known_gender_rows", "SELECT SK_ID_CURR, CODE_GENDER FROM applications WHERE CODE_GENDER <> 'XNA'")
def _(t):
    return t.applications.where(labels.known_gender()).select(X.ID, "CODE_GENDER")


@query(
    "status_labels",
    """SELECT SK_ID_CURR, CASE TARGET WHEN 0 THEN 'Repaid' WHEN 1 THEN 'Defaulted' END AS status FROM applications""",
)
def _(t):
    return t.applications.select(X.ID, labels.status().alias("status"))


@query(
    "age_in_years",
    """SELECT SK_ID_CURR, TARGET, DAYS_BIRTH / -365e0 AS age_years,
  CAST(trunc(DAYS_BIRTH / -365e0) AS BIGINT) AS whole_years FROM applications""",
)
def _(t):
    return t.applications.select(
        X.ID, X.TARGET, features.age_years().alias("age_years"), features.whole_age_years().alias("whole_years")
    )


@query(
    "application_inputs",
    """SELECT SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, round(DAYS_BIRTH * 1e0, 6) AS DAYS_BIRTH,
  round(CASE WHEN DAYS_EMPLOYED < 0 THEN DAYS_EMPLOYED * 1e0 ELSE 0e0 END, 6) AS DAYS_EMPLOYED,
  EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3, AMT_CREDIT / (AMT_INCOME_TOTAL + 1e0) AS DEBT_TO_INCOME,
  AMT_ANNUITY / (AMT_INCOME_TOTAL + 1e0) AS ANNUITY_TO_INCOME FROM applications""",
)
def _(t):
    form = frames.inputs_from_applications(t.applications)
    out = rounded(frames.application_inputs(form), 6, "DAYS_BIRTH", "DAYS_EMPLOYED")
    # A zero employment comes out as -0.0.
    return out.withColumn("DAYS_EMPLOYED", F.col("DAYS_EMPLOYED") + F.lit(0.0))


# Samples, caps, splits

def _first_of_class(n0: int, n1: int) -> str:
    return f"""SELECT SK_ID_CURR, TARGET FROM (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY k, SK_ID_CURR) AS r
FROM keyed) WHERE r <= CASE TARGET WHEN 1 THEN {n1} WHEN 0 THEN {n0} END"""


SAMPLE = {1: 80, 0: 920}


@query("stratified_sample", _first_of_class(920, 80), [shuffled("applications")])
def _(t):
    return sampling.stratified_sample(t.applications, SAMPLE).select(X.ID, X.TARGET)


@query(
    "sampled_bureau",
    "SELECT * FROM bureau WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sampled)",
    [shuffled("applications"), f"sampled AS ({_first_of_class(920, 80)})"],
)
def _(t):
    return sampling.subset_children(t.bureau, sampling.stratified_sample(t.applications, SAMPLE))


@query(
    "sampled_previous",
    "SELECT * FROM previous_application WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM sampled)",
    [shuffled("applications"), f"sampled AS ({_first_of_class(920, 80)})"],
)
def _(t):
    return sampling.subset_children(t.previous_application, sampling.stratified_sample(t.applications, SAMPLE))


@query(
    "defaulter_bureau_records",
    "SELECT * FROM bureau WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM applications WHERE TARGET = 1)",
)
def _(t):
    return sampling.subset_children(t.bureau, t.applications.where("TARGET = 1"))


@query(
    "class_concat",
    """SELECT SK_ID_CURR, TARGET, AMT_CREDIT FROM applications WHERE TARGET = 1
UNION ALL SELECT SK_ID_CURR, TARGET, AMT_CREDIT FROM applications WHERE TARGET = 0""",
)
def _(t):
    columns = (X.ID, X.TARGET, "AMT_CREDIT")
    return sampling.concat(*[t.applications.where(F.col(X.TARGET) == c).select(*columns) for c in (1, 0)])


@query("shuffle_order", "SELECT SK_ID_CURR, k AS shuffle_key FROM keyed", [shuffled("applications")])
def _(t):
    return sampling.with_shuffle_key(t.applications).select(X.ID, "shuffle_key")


@query(
    "deterministic_cap",
    "SELECT SK_ID_CURR, TARGET FROM keyed ORDER BY k, SK_ID_CURR LIMIT 1000",
    [shuffled("applications")],
)
def _(t):
    return sampling.deterministic_cap(t.applications, 1000).select(X.ID, X.TARGET)


@query(
    "stratified_split",
    """SELECT SK_ID_CURR, TARGET, r <= ceil(round(0.2e0 * n, 9)) AS is_test
FROM (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY k, SK_ID_CURR) AS r,
  count(*) OVER (PARTITION BY TARGET) AS n FROM keyed)""",
    [shuffled("applications")],
)
def _(t):
    return sampling.stratified_split(t.applications).select(X.ID, X.TARGET, "is_test")


MISSING_IDS = cte(
    "partial_ids",
    """SELECT * REPLACE (CASE WHEN SK_ID_CURR % 20 = 0 THEN NULL ELSE SK_ID_CURR END AS SK_ID_CURR) FROM applications""",
)
COPIED_IDS = cte(
    "copied_ids", "SELECT * REPLACE (CASE WHEN SK_ID_CURR % 3 = 0 THEN 7 ELSE SK_ID_CURR END AS SK_ID_CURR) FROM applications"
)


@query(
    "cap_with_missing_ids",
    """SELECT SK_ID_CURR, count(*) AS n FROM (SELECT SK_ID_CURR FROM keyed ORDER BY k NULLS FIRST, SK_ID_CURR NULLS FIRST LIMIT 1000)
GROUP BY 1""",
    [MISSING_IDS, shuffled("partial_ids")],
)
def _(t):
    partial = t.applications.withColumn(X.ID, F.when(F.col(X.ID) % 20 != 0, F.col(X.ID)))
    return sampling.deterministic_cap(partial, 1000).groupBy(X.ID).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_with_copies",
    """SELECT TARGET, SK_ID_CURR, r <= ceil(round(0.2e0 * n, 9)) AS is_test, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY k, SK_ID_CURR) AS r,
  count(*) OVER (PARTITION BY TARGET) AS n FROM keyed) GROUP BY 1, 2, 3""",
    [COPIED_IDS, shuffled("copied_ids")],
)
def _(t):
    copied = t.applications.withColumn(X.ID, F.when(F.col(X.ID) % 3 == 0, 7).otherwise(F.col(X.ID)))
    return sampling.stratified_split(copied).groupBy(X.TARGET, X.ID, "is_test").agg(F.count(F.lit(1)).alias("n"))


# Sources and ad hoc SQL

COUNTS = union([f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in schemas.SCHEMAS])


@query("table_row_counts", COUNTS)
def _(t):
    return schemas.verify_counts(t.named())


# A text column of each table; its values get quotes, a comma and outer spaces.
TEXTS = {"applications": "NAME_INCOME_TYPE", "bureau": "CREDIT_TYPE", "previous_application": "NAME_CONTRACT_TYPE"}
AMOUNTS = {"applications": "AMT_CREDIT", "bureau": "AMT_CREDIT_SUM", "previous_application": "AMT_CREDIT"}


def _written(t, folder, rows=None):
    """The loan tables as CSV files in a source folder."""
    for name, df in (rows or t.named()).items():
        csv.export_csv(df, f"{folder}/{csv.CSV_FILES[name]}")


@query(
    "load_manifest",
    union([f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TEXTS]),
)
def _(t):
    """The counts that were taken while the tables were loaded."""
    folder = scratch_path(t.spark, "manifest")
    _written(t, f"{folder}/raw")
    csv.ingest_csv(t.spark, f"{folder}/raw", f"{folder}/tables")
    return load_manifest(t.spark, f"{folder}/tables")


@query(
    "source_resolution",
    """SELECT 'raw alone' AS found, 'raw' AS taken, count(*) AS row_count FROM applications
UNION ALL SELECT 'raw and sample', 'sample', count(*) FROM applications WHERE TARGET = 1
UNION ALL SELECT 'raw asked for', 'raw', count(*) FROM applications""",
)
def _(t):
    """Which folder is taken, and the rows of its applications."""
    folder = scratch_path(t.spark, "sources")
    _written(t, f"{folder}/raw", {"applications": t.applications})
    taken = [("raw alone", csv.resolve_source(t.spark, folder))]
    _written(t, f"{folder}/sample", {"applications": t.applications.where("TARGET = 1")})
    taken += [
        ("raw and sample", csv.resolve_source(t.spark, folder)),
        ("raw asked for", csv.resolve_source(t.spark, folder, use_sample=False)),
    ]
    schema = schemas.SCHEMAS["applications"]
    return sampling.concat(
        *[
            csv.read_csv(t.spark, f"{source}/{csv.CSV_FILES['applications']}", schema).agg(
                F.lit(found).alias("found"),
                F.lit(source.rsplit("/", 1)[1]).alias("taken"),
                F.count(F.lit(1)).alias("row_count"),
            )
            for found, source in taken
        ]
    )


@query(
    "latin1_csv",
    """SELECT NAME_INCOME_TYPE || ' \u00e0 l''\u00e9tranger' AS description, count(*) AS row_count, CAST(sum(SK_ID_CURR) AS BIGINT) AS id_sum
FROM applications GROUP BY 1""",
)
def _(t):
    """A file in ISO-8859-1, written and read back."""
    path = scratch_path(t.spark, "latin1")
    described = F.concat("NAME_INCOME_TYPE", F.lit(" \u00e0 l'\u00e9tranger")).alias("description")
    csv.export_csv(t.applications.select(X.ID, described), path, schemas.DESCRIPTION_ENCODING)
    schema = T.StructType([T.StructField(X.ID, T.LongType()), T.StructField("description", T.StringType())])
    rows = csv.read_csv(t.spark, path, schema, schemas.DESCRIPTION_ENCODING)
    return rows.groupBy("description").agg(F.count(F.lit(1)).alias("row_count"), F.sum(X.ID).alias("id_sum"))


@query(
    "csv_ingest",
    union(
        [
            f"""SELECT '{n}' AS table_name, count(*) AS row_count, CAST(sum(SK_ID_CURR) AS BIGINT) AS id_sum,
  round(sum({AMOUNTS[n]}), 2) AS amount_sum, ' "' || {c} || '", "a, b" ' AS text FROM {n} GROUP BY {c}"""
            for n, c in TEXTS.items()
        ]
    ),
)
def _(t):
    folder = scratch_path(t.spark, "ingest")
    for name, df in t.named().items():
        quoted = F.concat(F.lit(' "'), F.col(TEXTS[name]), F.lit('", "a, b" '))
        csv.export_csv(df.withColumn(TEXTS[name], quoted), f"{folder}/raw/{csv.CSV_FILES[name]}")
    loaded = csv.ingest_csv(t.spark, csv.resolve_source(t.spark, folder), f"{folder}/tables")
    return sampling.concat(
        *[
            df.groupBy(F.col(TEXTS[name]).alias("text"))
            .agg(
                F.count(F.lit(1)).alias("row_count"),
                F.sum(X.ID).alias("id_sum"),
                F.round(F.sum(AMOUNTS[name]), 2).alias("amount_sum"),
            )
            .select(F.lit(name).alias("table_name"), "row_count", "id_sum", "amount_sum", "text")
            for name, df in loaded.items()
        ]
    )


LISTED = ", ".join(
    f"('{n}', {i}, '{c}')" for n, columns in COLUMNS.items() for i, c in enumerate(columns)
)


@query(
    "schema_reference",
    f"""SELECT table_name, CAST(position AS INT) AS position, column_name, row_count
FROM (VALUES {LISTED}) AS v(table_name, position, column_name) JOIN ({COUNTS}) USING (table_name)""",
)
def _(t):
    # Types and comments differ between engines; tests check them.
    return schemas.schema_reference(t.spark, t.named()).select("table_name", "position", "column_name", "row_count")


def _run(t: Tables, sql: str) -> DataFrame:
    for name, df in t.named().items():
        df.createOrReplaceTempView(name)
    df, error = adhoc.run_query(t.spark, sql)
    if error:
        raise ValueError(error)
    return df


@query(
    "guarded_sql",
    """SELECT CREDIT_ACTIVE, 'DROP; -- not a command' AS note, count(*) AS n,
  CAST(sum(CREDIT_DAY_OVERDUE) AS BIGINT) AS days_overdue FROM bureau GROUP BY 1""",
)
def _(t):
    return _run(
        t,
        """WITH per_status AS ( -- comments may say DELETE
  SELECT CREDIT_ACTIVE, count(*) AS n, sum(CREDIT_DAY_OVERDUE) AS days_overdue FROM bureau GROUP BY CREDIT_ACTIVE)
SELECT CREDIT_ACTIVE, 'DROP; -- not a command' AS note, n, days_overdue FROM per_status;""",
    )


EXAMPLES = {
    "example_default_rate": (
        "Portfolio Default Rate",
        f"SELECT count(*) AS total_borrowers, CAST(sum(TARGET) AS BIGINT) AS total_defaults, {RATE} AS default_rate_pct FROM applications",
    ),
    "example_gender": (
        "Default Rate by Gender",
        f"SELECT CODE_GENDER, count(*) AS count, {RATE} AS default_rate_pct FROM applications WHERE CODE_GENDER != 'XNA' GROUP BY 1",
    ),
    "example_income_types": (
        "Top 10 Income Types by Default Rate",
        f"""SELECT NAME_INCOME_TYPE, count(*) AS borrower_count, round(avg(AMT_INCOME_TOTAL), 0) AS avg_income,
  {RATE} AS default_rate_pct FROM applications GROUP BY 1 HAVING count(*) > 100 ORDER BY 4 DESC, 1 LIMIT 10""",
    ),
    "example_bureau_join": (
        "Bureau Data JOIN",
        f"""SELECT a.CODE_GENDER, count(DISTINCT a.SK_ID_CURR) AS borrowers, round(avg(b.loan_count), 1) AS avg_bureau_loans,
  {RATE} AS default_rate_pct FROM applications a
LEFT JOIN (SELECT SK_ID_CURR, count(*) AS loan_count FROM bureau GROUP BY 1) b ON a.SK_ID_CURR = b.SK_ID_CURR
WHERE a.CODE_GENDER != 'XNA' GROUP BY 1""",
    ),
    "example_previous": (
        "Previous Applications Analysis",
        f"""SELECT p.NAME_CONTRACT_STATUS, count(*) AS count, round(avg(a.AMT_INCOME_TOTAL), 0) AS avg_income,
  {RATE} AS default_rate_pct FROM applications a JOIN previous_application p ON a.SK_ID_CURR = p.SK_ID_CURR GROUP BY 1""",
    ),
    "example_age_groups": (
        "Age Analysis (Derived)",
        f"SELECT {AGE_GROUP} AS age_group, count(*) AS borrower_count, {RATE} AS default_rate_pct FROM applications GROUP BY 1",
    ),
}

for _name, (_title, _sql) in EXAMPLES.items():
    query(_name, _sql)(lambda t, title=_title: _run(t, sql_catalogue.EXAMPLE_QUERIES[title]))

TIPS = {
    "tip_rate_by_column": (
        "Default rate by any categorical column",
        f"SELECT NAME_CONTRACT_TYPE, count(*) AS count, {RATE} AS default_rate_pct FROM applications GROUP BY 1",
    ),
    "tip_age": ("Age analysis", "SELECT SK_ID_CURR, DAYS_BIRTH / -365e0 AS age_years, TARGET FROM applications"),
    "tip_bureau_count": (
        "Join with bureau data",
        """SELECT a.SK_ID_CURR, a.TARGET, count(b.SK_ID_BUREAU) AS bureau_count
FROM applications a LEFT JOIN bureau b ON a.SK_ID_CURR = b.SK_ID_CURR GROUP BY 1, 2""",
    ),
}

for _name, (_title, _sql) in TIPS.items():
    query(_name, _sql)(lambda t, title=_title: _run(t, sql_catalogue.QUERY_TIPS[title]))
