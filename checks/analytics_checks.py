"""Feature, distribution, correlation and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.constants import SEGMENTS
from checks.registry import query, rounded
from checks.sql import BORROWER, DERIVED, MODEL_ROWS, PREPARED, TIERS, cte, union
from creditloom import fixed as X
from creditloom.functions import labels
from creditloom.operators import distributions, drivers, frames, segmentation
from creditloom.operators import features as feats
from creditloom.operators.ranking import quantiles

DERIVED_ROWS = cte("derived", f"SELECT *, {DERIVED} FROM applications")


# Features

@query("derived_features", f"SELECT SK_ID_CURR, {DERIVED} FROM applications")
def _(t):
    return feats.add_derived_features(t.applications).select(X.ID, *X.DERIVED)


@query(
    "score_medians",
    f"SELECT {', '.join(f'round(median({c}), 9) AS {c}' for c in X.SCORES)} FROM applications",
)
def _(t):
    found = quantiles(t.applications, {c: (0.5,) for c in X.SCORES})
    return rounded(found.groupBy().pivot("column", list(X.SCORES)).agg(F.first("value")), 9, *X.SCORES)


@query(
    "quantiles",
    union(
        [
            f"SELECT '{c}' AS \"column\", {p}e0 AS p, round(quantile_cont({c}, {p}), 6) AS value, count({c}) AS n FROM applications"
            for c, ps in (("AMT_INCOME_TOTAL", (0.01, 0.5, 0.95, 0.99)), ("AMT_ANNUITY", (0.25, 0.75)), ("DAYS_EMPLOYED", (0.9,)))
            for p in ps
        ]
    ),
)
def _(t):
    probs = {"AMT_INCOME_TOTAL": (0.01, 0.5, 0.95, 0.99), "AMT_ANNUITY": (0.25, 0.75), "DAYS_EMPLOYED": (0.9,)}
    return rounded(quantiles(t.applications, probs), 6, "value")


@query(
    "income_axis_cap",
    "SELECT round(quantile_cont(AMT_INCOME_TOTAL, 0.95), 6) AS axis_cap FROM applications WHERE EXT_SOURCE_2 IS NOT NULL",
)
def _(t):
    frame = frames.clustering_frame(t.applications)
    return quantiles(frame, {"AMT_INCOME_TOTAL": (0.95,)}).select(F.round("value", 6).alias("axis_cap"))


CLIPPED = ("DEBT_TO_INCOME", "ANNUITY_TO_INCOME")


@query(
    "clipped_ratios",
    f"""SELECT SK_ID_CURR, {', '.join(
        f'round(CASE WHEN {c} < l{i} THEN l{i} WHEN {c} > h{i} THEN h{i} ELSE {c} END, 9) AS {c}'
        for i, c in enumerate(CLIPPED))}
FROM derived, (SELECT {', '.join(
        f'quantile_cont({c}, 0.01) AS l{i}, quantile_cont({c}, 0.99) AS h{i}' for i, c in enumerate(CLIPPED))} FROM derived)""",
    [DERIVED_ROWS],
)
def _(t):
    clipped = feats.clip_outliers(feats.add_derived_features(t.applications), CLIPPED)
    return rounded(clipped.select(X.ID, *CLIPPED), 9, *CLIPPED)


IMPUTED_ZERO = (
    "AMT_ANNUITY",
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "DEF_30_CNT_SOCIAL_CIRCLE",
    "AMT_REQ_CREDIT_BUREAU_YEAR",
    "ANNUITY_TO_INCOME",
    "EXT_SOURCE_AVG",
)


@query(
    "imputed_frame",
    f"""SELECT SK_ID_CURR, TARGET, {', '.join(f'coalesce({c}, m{i}) AS {c}' for i, c in enumerate(X.SCORES))},
  {', '.join(f'coalesce({c}, 0e0) AS {c}' for c in IMPUTED_ZERO)}
FROM derived, (SELECT {', '.join(f'median({c}) AS m{i}' for i, c in enumerate(X.SCORES))} FROM derived)""",
    [DERIVED_ROWS],
)
def _(t):
    imputed = feats.impute_nulls(feats.add_derived_features(t.applications))
    return imputed.select(X.ID, X.TARGET, *X.SCORES, *IMPUTED_ZERO)


@query(
    "clustering_features",
    f"SELECT SK_ID_CURR, {', '.join(f'round({c}, 9) AS {c}' for c in X.CLUSTER_FEATURES)} FROM prepared",
    PREPARED,
)
def _(t):
    prepared, names = feats.prepare_clustering_data(frames.clustering_frame(t.applications))
    return rounded(prepared.select(X.ID, *names), 9, *names)


@query(
    "model_features",
    f"""SELECT SK_ID_CURR, TARGET, AMT_INCOME_TOTAL, AMT_CREDIT, coalesce(AMT_ANNUITY, 0e0) AS AMT_ANNUITY, DAYS_BIRTH,
  CASE WHEN DAYS_EMPLOYED > 0 THEN 0 ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED,
  coalesce(EXT_SOURCE_1, m1) AS EXT_SOURCE_1, coalesce(EXT_SOURCE_2, m2) AS EXT_SOURCE_2,
  coalesce(EXT_SOURCE_3, m3) AS EXT_SOURCE_3, DEBT_TO_INCOME, coalesce(ANNUITY_TO_INCOME, 0e0) AS ANNUITY_TO_INCOME
FROM derived, (SELECT median(EXT_SOURCE_1) AS m1, median(EXT_SOURCE_2) AS m2, median(EXT_SOURCE_3) AS m3 FROM derived)""",
    [cte("derived", f"SELECT {BORROWER}, {DERIVED} FROM applications WHERE TARGET IS NOT NULL")],
)
def _(t):
    frame, names = feats.prepare_model_features(frames.training_frame(t.applications))
    return frame.select(X.ID, X.TARGET, *names)


@query(
    "sentinel_fixed",
    "SELECT SK_ID_CURR, CASE WHEN DAYS_EMPLOYED > 0 THEN 0 ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED FROM applications",
)
def _(t):
    return feats.fix_sentinel(t.applications).select(X.ID, "DAYS_EMPLOYED")


@query(
    "scaler_moments",
    union(
        [
            f"SELECT '{f}' AS \"column\", round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS std FROM model_rows"
            for f in X.MODEL_FEATURES
        ]
    ),
    [MODEL_ROWS],
)
def _(t):
    frame, names = feats.prepare_model_features(frames.training_frame(t.applications), impute=False)
    return rounded(feats.moments(frame, names), 4, "mean", "std")


# Distributions

STATUS = "CASE TARGET WHEN 0 THEN 'Repaid' WHEN 1 THEN 'Defaulted' END AS status"


def _histogram_sql(column: str, where: str, density: bool = False) -> str:
    share = ""
    if density:
        share = ", round(count(*) / (sum(count(*)) OVER (PARTITION BY status) * ((max(hi) - max(lo)) / 50e0)), 6) AS density"
    return f"""SELECT status, bin, round(max(lo) + bin * ((max(hi) - max(lo)) / 50e0), 6) AS bin_start,
  round(max(lo) + (bin + 1) * ((max(hi) - max(lo)) / 50e0), 6) AS bin_end, count(*) AS count{share}
FROM (SELECT {STATUS}, lo, hi, least(CAST(floor(({column} - lo) / ((hi - lo) / 50e0)) AS BIGINT), 49) AS bin
  FROM applications, (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM applications WHERE {where})
  WHERE {where}) GROUP BY status, bin"""


def _with_status(df):
    return df.withColumn("status", labels.status())


@query("income_histogram", _histogram_sql("AMT_INCOME_TOTAL", "AMT_INCOME_TOTAL <= 1000000"))
def _(t):
    values = frames.capped_values(t.applications, "AMT_INCOME_TOTAL", X.INCOME_CAP)
    return rounded(distributions.histogram(_with_status(values), "AMT_INCOME_TOTAL", "status"), 6, "bin_start", "bin_end")


@query("credit_histogram", _histogram_sql("AMT_CREDIT", "AMT_CREDIT <= 2000000"))
def _(t):
    values = frames.capped_values(t.applications, "AMT_CREDIT", X.CREDIT_CAP)
    return rounded(distributions.histogram(_with_status(values), "AMT_CREDIT", "status"), 6, "bin_start", "bin_end")


def _density(feature: str):
    def run(t):
        values = _with_status(frames.feature_by_target(t.applications, feature))
        out = distributions.density_histogram(values, feature, "status")
        return rounded(out, 6, "bin_start", "bin_end", "density")

    return run


for _feature in ("EXT_SOURCE_2", "DAYS_BIRTH", "AMT_ANNUITY"):
    query(f"density_{_feature.lower()}", _histogram_sql(_feature, f"{_feature} IS NOT NULL", True))(_density(_feature))


@query(
    "profile",
    union(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM applications"""
            for c in ("SK_ID_CURR", "TARGET", *X.DRIVERS)
        ]
    ),
)
def _(t):
    return rounded(
        rounded(distributions.profile(t.applications), 4, "mean", "std"), 6, "p25", "p50", "p75"
    )


# Correlation

def _corr_rows() -> str:
    return union(
        [
            f"SELECT '{f}' AS feature, corr({f}, TARGET) AS r FROM derived"
            for f in (*X.DRIVERS, *X.DERIVED)
        ]
    )


@query(
    "target_correlation",
    f"""SELECT feature, round(r, 6) AS correlation, round(abs(r), 6) AS abs_correlation,
  CASE WHEN r > 0 THEN 'Increases Default' ELSE 'Decreases Default' END AS direction
FROM ({_corr_rows()}) ORDER BY round(abs(r), 9) DESC, feature LIMIT 15""",
    [DERIVED_ROWS],
)
def _(t):
    out = drivers.target_correlation(frames.driver_frame(t.applications))
    return rounded(out, 6, "correlation", "abs_correlation")


@query(
    "correlation_matrix",
    union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM applications"
            for a in X.HEATMAP
            for b in X.HEATMAP
        ]
    ),
)
def _(t):
    return rounded(drivers.correlation_matrix(t.applications, X.HEATMAP), 6, "r")


# Segmentation with given centres

def _tiers(t, stored=False):
    return segmentation.segment(t.applications, SEGMENTS, stored)[0]


@query("assigned_clusters", "SELECT SK_ID_CURR, cluster FROM clustered", TIERS)
def _(t):
    prepared, _names = feats.prepare_clustering_data(frames.clustering_frame(t.applications))
    return segmentation.assign_clusters(prepared, SEGMENTS).select(X.ID, "cluster")


@query("risk_tiers", "SELECT SK_ID_CURR, RISK_TIER, round(EXT_SOURCE_AVG, 9) AS EXT_SOURCE_AVG FROM tiers", TIERS)
def _(t):
    return rounded(_tiers(t).select(X.ID, "RISK_TIER", "EXT_SOURCE_AVG"), 9, "EXT_SOURCE_AVG")


TIER_SUMMARY = """SELECT RISK_TIER, count(SK_ID_CURR) AS count, round(avg(TARGET) * 100e0, 2) AS default_rate_pct,
  round(avg(EXT_SOURCE_AVG), 3) AS avg_score, round(avg(DEBT_TO_INCOME), 2) AS avg_debt_to_income,
  round(avg(AGE_YEARS), 1) AS avg_age, round(avg(AMT_INCOME_TOTAL), 0) AS avg_income FROM tiers GROUP BY 1"""


@query("tier_summary", TIER_SUMMARY, TIERS)
def _(t):
    return segmentation.tier_summary(_tiers(t))


@query(
    "tier_summary_text",
    f"""SELECT * REPLACE (format('{{:.2f}}%', default_rate_pct) AS default_rate_pct,
  format('${{:,.0f}}', avg_income) AS avg_income) FROM ({TIER_SUMMARY})""",
    TIERS,
)
def _(t):
    return segmentation.tier_summary_text(_tiers(t))


@query("tier_default_rate", "SELECT RISK_TIER, round(avg(TARGET) * 100e0, 6) AS default_rate_pct FROM tiers GROUP BY 1", TIERS)
def _(t):
    return rounded(segmentation.default_rate_by_tier(_tiers(t)), 6, "default_rate_pct")


def _box_sql(value: str) -> str:
    return f"""SELECT RISK_TIER, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, n,
  whisker_low, whisker_high, outliers
FROM (SELECT RISK_TIER, q1, median, q3, count({value}) AS n,
  min({value}) FILTER (WHERE {value} >= q1 - 1.5e0 * (q3 - q1)) AS whisker_low,
  max({value}) FILTER (WHERE {value} <= q3 + 1.5e0 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE {value} < q1 - 1.5e0 * (q3 - q1) OR {value} > q3 + 1.5e0 * (q3 - q1)) AS outliers
  FROM tiers JOIN (SELECT RISK_TIER, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
    quantile_cont({value}, 0.75) AS q3 FROM tiers GROUP BY 1) USING (RISK_TIER)
  GROUP BY 1, 2, 3, 4)"""


@query("income_box_by_tier", _box_sql("AMT_INCOME_TOTAL"), TIERS)
def _(t):
    out = distributions.box_stats(_tiers(t, stored=True), "AMT_INCOME_TOTAL", "RISK_TIER", X.RISK_TIERS)
    return rounded(out, 6, "q1", "median", "q3")


@query("age_box_by_tier", _box_sql("AGE_YEARS"), TIERS)
def _(t):
    out = distributions.box_stats(_tiers(t, stored=True), "AGE_YEARS", "RISK_TIER", X.RISK_TIERS)
    return rounded(out, 6, "q1", "median", "q3")


# Fits: rows only

@query(
    "kmeans_segment",
    """SELECT (SELECT count(*) FROM applications WHERE EXT_SOURCE_2 IS NOT NULL) AS rows_kept, CAST(3 AS BIGINT) AS tiers,
  true AS ordered_by_score, true AS no_dearer_than_one_seed, true AS centres_are_means""",
)
def _(t):
    """All rows kept, tiers in the order of their scores, restarts that only help, and a fixed point.

    Every centre is the mean of the rows that are nearest to it, up to the tolerance of the fit.
    """
    tiers, fitted = segmentation.segment(t.applications)
    prepared, features = feats.prepare_clustering_data(frames.clustering_frame(t.applications))
    single = segmentation.fit_kmeans(prepared, features, restarts=1)
    scaled = feats.scale(segmentation.assign_clusters(prepared, fitted), fitted.moments)
    means = scaled.groupBy("cluster").agg(*[F.avg(f"z_{f}").alias(f) for f in features]).collect()
    gap = max(abs(r[f] - fitted.centres[r["cluster"]][i]) for r in means for i, f in enumerate(features))
    score = {name: F.avg(F.when(F.col("RISK_TIER") == name, F.col("EXT_SOURCE_AVG"))) for name in X.RISK_TIERS}
    low, medium, high = (score[name] for name in X.RISK_TIERS)
    return tiers.agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.count_distinct("RISK_TIER").alias("tiers"),
        ((low > medium) & (medium > high)).alias("ordered_by_score"),
        F.lit(fitted.cost <= single.cost).alias("no_dearer_than_one_seed"),
        F.lit(len(means) == X.CLUSTERS and gap < 1e-3).alias("centres_are_means"),
    )


NAN_DRIVERS = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "EXT_SOURCE_2")


@query(
    "correlation_with_nan",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN '{a}' = '{b}' THEN 1e0 ELSE corr({a}, {b}) END, 9) AS r
FROM (SELECT AMT_INCOME_TOTAL, EXT_SOURCE_2, CASE WHEN SK_ID_CURR % 50 = 0 THEN NULL ELSE AMT_CREDIT END AS AMT_CREDIT
  FROM applications)"""
        for a in NAN_DRIVERS
        for b in NAN_DRIVERS
    ),
)
def _(t):
    holed = F.when(F.col(X.ID) % 50 == 0, F.lit(float("nan"))).otherwise(F.col("AMT_CREDIT"))
    return rounded(drivers.correlation_matrix(t.applications.withColumn("AMT_CREDIT", holed), NAN_DRIVERS), 9, "r")


@query(
    "profile_with_nan",
    """SELECT 'AMT_CREDIT' AS "column", count(x) AS "count", round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
  min(x) AS "min", round(median(x), 4) AS p50, max(x) AS "max"
FROM (SELECT CASE WHEN SK_ID_CURR % 50 = 0 THEN NULL ELSE AMT_CREDIT END AS x FROM applications)""",
)
def _(t):
    holed = F.when(F.col(X.ID) % 50 == 0, F.lit(float("nan"))).otherwise(F.col("AMT_CREDIT"))
    out = distributions.profile(t.applications.select(holed.alias("AMT_CREDIT"))).drop("p25", "p75")
    return rounded(out, 4, "mean", "std", "p50")
