"""Scoring, evaluation, decision and explanation queries; model fits (rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.constants import FIRST, SECOND
from checks.registry import query, rounded
from checks.sql import ATTRIBUTION, BAND, MODEL_ROWS, cte, logit, phi, probability, union
from creditloom import fixed as X
from creditloom.functions import labels
from creditloom.operators import evaluation, explain, frames, modelling, scoring
from creditloom.operators import features as feats
from creditloom.session import scratch_path
from creditloom.sources import stores, versions

SCORED = cte("scored", f"SELECT *, {probability(FIRST)} AS p, {probability(SECOND)} AS p2 FROM model_rows")
LOGITS = cte("logits", f"SELECT SK_ID_CURR, TARGET, {logit(FIRST)} AS s FROM model_rows")
BOTH = cte(
    "both_models",
    """SELECT 'first' AS model, SK_ID_CURR, TARGET, p FROM scored
UNION ALL SELECT 'second', SK_ID_CURR, TARGET, p2 FROM scored""",
)


def _rows(t):
    return feats.prepare_model_features(frames.training_frame(t.applications), impute=False)[0]


def _scored(t):
    return scoring.predict_proba(_rows(t), FIRST)


def _both(t):
    return scoring.predict_all(_rows(t), {"first": FIRST, "second": SECOND})


# Preprocessing

TRAIN_MEDIANS = ", ".join(f"median({f}) AS {f}" for f in X.MODEL_FEATURES)


@query(
    "balanced_weights",
    """SELECT SK_ID_CURR, TARGET, round(CASE TARGET WHEN 1 THEN n / (2e0 * n1) WHEN 0 THEN n / (2e0 * n0) END, 9) AS weight
FROM model_rows, (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE TARGET = 1) AS n1,
  count(*) FILTER (WHERE TARGET = 0) AS n0 FROM model_rows)""",
    [MODEL_ROWS],
)
def _(t):
    weighted = modelling.balanced_weights(_rows(t).select(X.ID, X.TARGET))
    return rounded(weighted, 9, "weight")


@query(
    "imputed_and_scaled",
    f"""SELECT SK_ID_CURR, {', '.join(f'round((coalesce(r.{f}, m.{f}) - a{i}) / d{i}, 6) AS z_{f}' for i, f in enumerate(X.MODEL_FEATURES))}
FROM model_rows r, (SELECT {TRAIN_MEDIANS} FROM model_rows) m,
  (SELECT {', '.join(f'avg(coalesce(r.{f}, m.{f})) AS a{i}, stddev_pop(coalesce(r.{f}, m.{f})) AS d{i}' for i, f in enumerate(X.MODEL_FEATURES))}
   FROM model_rows r, (SELECT {TRAIN_MEDIANS} FROM model_rows) m) s""",
    [MODEL_ROWS],
)
def _(t):
    rows = _rows(t)
    prep = modelling.fit_preprocessor(rows)
    names = [f"z_{f}" for f in X.MODEL_FEATURES]
    return rounded(prep.stage().transform(rows).select(X.ID, *names), 6, *names)


# Scores and metrics

@query(
    "scores",
    "SELECT SK_ID_CURR, round(p, 9) AS p, CASE WHEN p > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM scored",
    [MODEL_ROWS, SCORED],
)
def _(t):
    return rounded(_scored(t).select(X.ID, "p", "prediction"), 9, "p")


@query(
    "binary_metrics",
    """SELECT model, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0e0), 9) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0e0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 9) AS f1
FROM (SELECT model, count(*) FILTER (WHERE TARGET = 1 AND p > 0.3e0) AS tp, count(*) FILTER (WHERE TARGET = 0 AND p > 0.3e0) AS fp,
  count(*) FILTER (WHERE TARGET = 1 AND p <= 0.3e0) AS fn, count(*) FILTER (WHERE TARGET = 0 AND p <= 0.3e0) AS tn
  FROM both_models GROUP BY model)""",
    [MODEL_ROWS, SCORED, BOTH],
)
def _(t):
    out = evaluation.binary_metrics(_both(t), by=["model"], threshold=0.3)
    return rounded(out, 9, "precision", "recall", "f1")


AUC = """SELECT model, round((sum(CASE WHEN TARGET = 1 THEN r END) - n1 * (n1 + 1) / 2e0) / (CAST(n1 AS DOUBLE) * n0), 9) AS auc
FROM (SELECT model, TARGET, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2e0 AS r,
  count(*) FILTER (WHERE TARGET = 1) OVER (PARTITION BY model) AS n1,
  count(*) FILTER (WHERE TARGET = 0) OVER (PARTITION BY model) AS n0 FROM logit_rows) GROUP BY model, n1, n0"""
LOGIT_ROWS = cte(
    "logit_rows",
    f"""SELECT 'first' AS model, TARGET, {logit(FIRST)} AS s FROM model_rows
UNION ALL SELECT 'second', TARGET, {logit(SECOND)} FROM model_rows""",
)


# The same over probabilities: distinct logits may share one.
PROBABILITY_ROWS = cte("logit_rows", "SELECT model, TARGET, p AS s FROM both_models")


@query("roc_auc", AUC, [MODEL_ROWS, LOGIT_ROWS])
def _(t):
    rows = _rows(t)
    both = [rows.select(F.lit(n).alias("model"), X.TARGET, m.logit().alias("s")) for n, m in (("first", FIRST), ("second", SECOND))]
    return rounded(evaluation.roc_auc(both[0].unionByName(both[1]), score="s", by=["model"]), 9, "auc")


@query(
    "roc_points",
    """SELECT round(s, 6) AS threshold, tp, fp, round(tp / CAST(sum(pos) OVER () AS DOUBLE), 9) AS tpr,
  round(fp / CAST(sum(neg) OVER () AS DOUBLE), 9) AS fpr
FROM (SELECT *, CAST(sum(pos) OVER (ORDER BY s DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY s DESC) AS BIGINT) AS fp
  FROM (SELECT s, count(*) FILTER (WHERE TARGET = 1) AS pos, count(*) FILTER (WHERE TARGET = 0) AS neg FROM logits GROUP BY s))
UNION ALL SELECT NULL, 0, 0, 0e0, 0e0""",
    [MODEL_ROWS, LOGITS],
)
def _(t):
    logits = _rows(t).select(X.TARGET, FIRST.logit().alias("s"))
    start = F.col("threshold") == float("inf")
    points = evaluation.roc_curve(logits, score="s").withColumn("threshold", F.when(~start, F.col("threshold")))
    return rounded(rounded(points, 6, "threshold"), 9, "tpr", "fpr")


CELLS = cte(
    "cells",
    """SELECT model, count(*) FILTER (WHERE TARGET = 1 AND p > 0.5e0) AS tp, count(*) FILTER (WHERE TARGET = 0 AND p > 0.5e0) AS fp,
  count(*) FILTER (WHERE TARGET = 1 AND p <= 0.5e0) AS fn FROM both_models GROUP BY model""",
)
METRICS = f"""SELECT model, 'auc' AS metric, auc AS value FROM ({AUC})
  UNION ALL SELECT model, 'precision', coalesce(tp / nullif(tp + fp, 0), 0e0) FROM cells
  UNION ALL SELECT model, 'recall', coalesce(tp / nullif(tp + fn, 0), 0e0) FROM cells
  UNION ALL SELECT model, 'f1', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0e0) FROM cells"""


@query(
    "compare_models",
    f"""SELECT metric, round("first", 6) AS "first", round("second", 6) AS "second",
  CASE WHEN metric IN ('auc', 'f1') THEN CASE WHEN "first" > "second" THEN 'first' ELSE 'second' END END AS winner,
  round(CASE WHEN metric IN ('auc', 'f1') THEN abs("first" - "second") END, 6) AS margin
FROM (SELECT metric, max(value) FILTER (WHERE model = 'first') AS "first", max(value) FILTER (WHERE model = 'second') AS "second"
FROM ({METRICS}) GROUP BY metric)""",
    [
        MODEL_ROWS,
        SCORED,
        BOTH,
        PROBABILITY_ROWS,
        CELLS,
    ],
)
def _(t):
    out = evaluation.compare_models(evaluation.evaluate(_both(t)), "first", "second")
    return rounded(out, 6, "first", "second", "margin")


# Decisions

@query(
    "risk_bands",
    f"SELECT SK_ID_CURR, {BAND.format('p')} AS risk_band, round(least(p, 1e0), 9) AS gauge FROM scored",
    [MODEL_ROWS, SCORED],
)
def _(t):
    out = scoring.score(_rows(t), {"logreg": FIRST, "gbt": SECOND})
    return rounded(out.select(X.ID, "risk_band", "gauge"), 9, "gauge")


@query(
    "risk_band_counts",
    f"SELECT {BAND.format('p2')} AS risk_band, count(*) AS n FROM scored GROUP BY 1",
    [MODEL_ROWS, SCORED],
)
def _(t):
    scored = scoring.score(_rows(t), {"logreg": FIRST, "gbt": SECOND}, model="gbt")
    return scored.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "model_agreement",
    """SELECT SK_ID_CURR, round(abs(p - p2) * 100e0, 6) AS difference,
  CASE WHEN abs(p - p2) * 100e0 > 10 THEN 'Significant' WHEN abs(p - p2) * 100e0 > 5 THEN 'Moderate' ELSE 'Aligned' END AS agreement
FROM scored""",
    [MODEL_ROWS, SCORED],
)
def _(t):
    out = scoring.compare_predictions(_rows(t), FIRST, SECOND)
    return rounded(out.select(X.ID, "difference", "agreement"), 6, "difference")


INPUTS = cte(
    "inputs",
    """SELECT SK_ID_CURR, AMT_INCOME_TOTAL AS income, AMT_CREDIT AS loan_amount, AMT_ANNUITY AS annuity,
  DAYS_BIRTH / -365e0 AS age, CASE WHEN DAYS_EMPLOYED < 0 THEN DAYS_EMPLOYED / -365e0 ELSE 0e0 END AS employed_years,
  EXT_SOURCE_1 AS e1, EXT_SOURCE_2 AS e2, EXT_SOURCE_3 AS e3,
  CASE WHEN n > 0 THEN total / n END AS avg_score
FROM (SELECT *, coalesce(EXT_SOURCE_1, 0e0) + coalesce(EXT_SOURCE_2, 0e0) + coalesce(EXT_SOURCE_3, 0e0) AS total,
  (EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT + (EXT_SOURCE_3 IS NOT NULL)::INT AS n FROM applications)""",
)
RULES = cte(
    "found",
    union(
        [
            f"""SELECT SK_ID_CURR, 'scores' AS factor, CASE WHEN avg_score < 0.3e0 THEN '[-]' ELSE '+' END AS effect,
  CASE WHEN avg_score < 0.3e0 THEN '{X.LOW_SCORES}' ELSE '{X.HIGH_SCORES}' END AS text
FROM inputs WHERE avg_score < 0.3e0 OR avg_score > 0.6e0""",
            """SELECT SK_ID_CURR, 'debt', CASE WHEN loan_amount / income > 5 THEN '[-]' ELSE '+' END,
  CASE WHEN loan_amount / income > 5 THEN format('High debt-to-income ratio ({:.1f}x) increases risk', loan_amount / income)
    ELSE format('Low debt-to-income ratio ({:.1f}x) is favorable', loan_amount / income) END
FROM inputs WHERE loan_amount / income > 5 OR loan_amount / income < 2""",
            f"""SELECT SK_ID_CURR, 'age', CASE WHEN age < 25 THEN '[~]' ELSE '+' END,
  CASE WHEN age < 25 THEN '{X.YOUNG}' ELSE '{X.MATURE}' END FROM inputs WHERE age < 25 OR age > 45""",
            f"""SELECT SK_ID_CURR, 'employment', CASE WHEN employed_years < 1 THEN '[-]' ELSE '+' END,
  CASE WHEN employed_years < 1 THEN '{X.SHORT_EMPLOYMENT}' ELSE '{X.STABLE_EMPLOYMENT}' END
FROM inputs WHERE employed_years < 1 OR employed_years > 5""",
            """SELECT SK_ID_CURR, 'annuity', '[-]',
  format('High annuity-to-income ratio ({:.1f}%) strains repayment capacity', annuity / income * 100e0)
FROM inputs WHERE annuity / income > 0.3e0""",
        ]
    ),
)


@query(
    "risk_factors",
    f"""SELECT * FROM found UNION ALL SELECT SK_ID_CURR, 'balanced', '', '{X.BALANCED}' FROM inputs
WHERE SK_ID_CURR NOT IN (SELECT SK_ID_CURR FROM found)""",
    [INPUTS, RULES],
)
def _(t):
    form = frames.inputs_from_applications(t.applications)
    return scoring.risk_factors_long(form).drop("position")


@query(
    "average_bureau_score",
    "SELECT SK_ID_CURR, round(avg_score, 9) AS avg_score FROM inputs",
    [INPUTS],
)
def _(t):
    full = feats.add_derived_features(t.applications)
    return full.select(X.ID, F.round("EXT_SOURCE_AVG", 9).alias("avg_score"))


@query(
    "input_summary",
    union(
        [
            f"SELECT SK_ID_CURR, '{name}' AS parameter, CASE WHEN {x} IS NOT NULL THEN {text} END AS value FROM inputs"
            for name, x, text in (
                ("Annual Income", "income", "format('${:,.0f}', income)"),
                ("Loan Amount", "loan_amount", "format('${:,.0f}', loan_amount)"),
                ("Annual Payment", "annuity", "format('${:,.0f}', annuity)"),
                ("Age", "age", "format('{:.0f} years', age)"),
                ("Years Employed", "employed_years", "format('{:.0f} years', employed_years)"),
                ("Bureau Score 1", "e1", "format('{:.2f}', e1)"),
                ("Bureau Score 2", "e2", "format('{:.2f}', e2)"),
                ("Bureau Score 3", "e3", "format('{:.2f}', e3)"),
                ("Debt-to-Income", "loan_amount", "format('{:.2f}x', loan_amount / income)"),
                ("Annuity-to-Income", "annuity", "format('{:.1f}%', annuity / income * 100e0)"),
            )
        ]
    ),
    [INPUTS],
)
def _(t):
    return scoring.input_summary(frames.inputs_from_applications(t.applications))


# Explanation

def _attributed(t, background=False):
    rows = _rows(t)
    return explain.linear_attribution(rows, FIRST, rows if background else None)


@query(
    "attributions",
    f"SELECT SK_ID_CURR, {FIRST.intercept}::DOUBLE AS base, "
    + ", ".join(f"round({phi(f, FIRST)}, 6) AS phi_{f}" for f in X.MODEL_FEATURES)
    + " FROM model_rows",
    [MODEL_ROWS],
)
def _(t):
    names = [f"phi_{f}" for f in X.MODEL_FEATURES]
    return rounded(explain.attribution_wide(_attributed(t), X.MODEL_FEATURES), 6, *names)


@query(
    "attributions_against_all_rows",
    """SELECT SK_ID_CURR, feature, round(phi - avg(phi) OVER (PARTITION BY feature), 6) AS phi FROM attribution""",
    [MODEL_ROWS, ATTRIBUTION],
)
def _(t):
    out = explain.attribution_long(_attributed(t, background=True)).select(X.ID, "feature", "phi")
    return rounded(out, 6, "phi")


@query(
    "additivity",
    f"""SELECT count(*) AS rows, round(avg(s), 6) AS base, round(avg(s), 6) AS mean_logit, 0e0 AS max_gap FROM logits""",
    [MODEL_ROWS, LOGITS],
)
def _(t):
    return rounded(explain.additivity(_attributed(t, background=True)), 6, "base", "mean_logit", "max_gap")


NAMES = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{n}'" for f, n in X.DISPLAY_NAMES.items()) + " END"


@query(
    "global_importance",
    f"""SELECT feature, {NAMES} AS name, round(avg(abs(phi)), 6) AS mean_abs_phi,
  CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS INT) AS rank FROM attribution GROUP BY feature""",
    [MODEL_ROWS, ATTRIBUTION],
)
def _(t):
    return rounded(explain.global_importance(_rows(t), FIRST), 6, "mean_abs_phi")


SIDES = union(
    [
        f"""SELECT SK_ID_CURR, '{side}' AS side, rank, feature, value, phi FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY phi {order}, i) AS INT) AS rank
  FROM attribution WHERE phi {test}) WHERE rank <= 3"""
        for side, order, test in (("increasing", "DESC", "> 0.01e0"), ("decreasing", "ASC", "< -0.01e0"))
    ]
)


@query(
    "top_factors",
    f"SELECT SK_ID_CURR, side, rank, feature, round(value, 6) AS value, round(phi, 6) AS phi FROM ({SIDES})",
    [MODEL_ROWS, ATTRIBUTION],
)
def _(t):
    return rounded(explain.top_factors(_attributed(t)), 6, "value", "phi")


VALUE_TEXT = """CASE WHEN value IS NULL THEN 'missing' WHEN feature = 'AMT_INCOME_TOTAL' THEN format('${:,.0f}', value)
  WHEN feature IN ('DAYS_BIRTH', 'DAYS_EMPLOYED') THEN format('{:.1f} years', abs(value) / 365e0)
  ELSE format('{:.2f}', value) END"""


@query(
    "explanation_text",
    f"""SELECT SK_ID_CURR, coalesce(string_agg(piece, '; ' ORDER BY rank) FILTER (WHERE side = 'increasing'), '') AS increasing_text,
  coalesce(string_agg(piece, '; ' ORDER BY rank) FILTER (WHERE side = 'decreasing'), '') AS decreasing_text
FROM model_rows LEFT JOIN (SELECT SK_ID_CURR, side, rank, {NAMES} || ' (' || {VALUE_TEXT} || '): ' || format('{{:+.3f}}', phi) AS piece
  FROM ({SIDES})) USING (SK_ID_CURR) GROUP BY 1""",
    [MODEL_ROWS, ATTRIBUTION],
)
def _(t):
    return explain.explanation_text(_attributed(t))


@query(
    "waterfall",
    f"""SELECT SK_ID_CURR, step, feature, round(phi, 6) AS phi, round("start", 6) AS "start", round("end", 6) AS "end" FROM (
  SELECT SK_ID_CURR, CAST(row_number() OVER w AS INT) AS step, feature, phi,
    {FIRST.intercept}::DOUBLE + sum(phi) OVER w - phi AS "start", {FIRST.intercept}::DOUBLE + sum(phi) OVER w AS "end"
  FROM attribution WINDOW w AS (PARTITION BY SK_ID_CURR ORDER BY abs(phi) DESC, i))
UNION ALL SELECT SK_ID_CURR, 11, 'Prediction', 0e0, 0e0, round(s, 6) FROM logits""",
    [MODEL_ROWS, ATTRIBUTION, LOGITS],
)
def _(t):
    return rounded(explain.waterfall(_attributed(t)), 6, "phi", "start", "end")


@query(
    "force_data",
    """SELECT SK_ID_CURR, CAST(row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY phi, i) AS INT) AS position, feature,
  round(phi, 6) AS phi, CASE WHEN phi > 0 THEN format('{:+.3f}', phi) ELSE format('{:.3f}', phi) END AS label,
  CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END AS effect FROM attribution""",
    [MODEL_ROWS, ATTRIBUTION],
)
def _(t):
    return rounded(explain.force_data(_attributed(t)), 6, "phi")


@query(
    "beeswarm",
    """SELECT SK_ID_CURR, feature, round(phi, 6) AS phi,
  round(coalesce((z - min(z) OVER f) / nullif(max(z) OVER f - min(z) OVER f, 0), 0e0), 6) AS color, rank
FROM attribution JOIN (SELECT feature, CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS INT) AS rank
  FROM attribution GROUP BY feature) USING (feature) WINDOW f AS (PARTITION BY feature)""",
    [MODEL_ROWS, ATTRIBUTION],
)
def _(t):
    return rounded(explain.beeswarm(_rows(t), FIRST), 6, "phi", "color")


# Stored metrics and fits

WEIGHTS = ", ".join(
    f"('importance', '{n}', '{f}', {abs(w)!r}::DOUBLE)" for n, m in (("first", FIRST), ("second", SECOND)) for f, w in m.weights.items()
)
TEST_ROWS = """(SELECT CAST(sum(n) AS BIGINT) FROM (SELECT ceil(round(0.2e0 * count(*), 9)) AS n FROM model_rows GROUP BY TARGET))"""


@query(
    "model_round_trip",
    f"""SELECT {TEST_ROWS} AS rows, 0e0 AS largest_difference, 'logreg' AS fallback, true AS refused_when_altered""",
    [MODEL_ROWS],
)
def _(t):
    """A saved model scores every test row as before, stands in for an absent one, and is refused when altered."""
    trained = modelling.train_models(t.applications, only=(X.LOGISTIC,))
    folder = scratch_path(t.spark, "models")
    stores.save_models(trained.models, folder)
    loaded = stores.load_model(t.spark, folder, "absent")
    test = trained.split.where("is_test")
    scored = scoring.predict_proba(test, trained.models[X.LOGISTIC]).withColumnRenamed("p", "before").drop("prediction")
    both = scoring.predict_proba(scored, loaded)
    other = modelling.fit_logistic(trained.split.where("NOT is_test"), trained.prep, c=1e-4)
    other.write().overwrite().save(f"{versions.current(t.spark, folder)}/{X.LOGISTIC}")
    try:
        stores.load_model(t.spark, folder)
        refused = False
    except stores.AlteredModel:
        refused = True
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.round(F.abs(F.col("p") - F.col("before")), 12)).alias("largest_difference"),
        F.lit(X.LOGISTIC).alias("fallback"),
        F.lit(refused).alias("refused_when_altered"),
    )


@query(
    "stored_metrics",
    f"""SELECT 'metrics' AS source, model, metric AS name, round(value, 6) AS value FROM ({METRICS})
UNION ALL SELECT 'roc', model, 'points', CAST(count(DISTINCT s) + 1 AS DOUBLE) FROM logit_rows GROUP BY model
UNION ALL SELECT 'roc', model, 'tp', CAST(sum(tp) AS DOUBLE) FROM (SELECT DISTINCT model, s,
  count(*) FILTER (WHERE TARGET = 1) OVER (PARTITION BY model ORDER BY s DESC) AS tp FROM logit_rows) GROUP BY model
UNION ALL SELECT * FROM (VALUES {WEIGHTS}) AS v(source, model, name, value)""",
    [MODEL_ROWS, SCORED, BOTH, PROBABILITY_ROWS, CELLS],
)
def _(t):
    folder = scratch_path(t.spark, "metrics")
    ordered = evaluation.ordered_scores(_both(t), by=["model"])
    importance = modelling.importance_frame(
        t.spark, [(n, f, abs(w)) for n, m in (("first", FIRST), ("second", SECOND)) for f, w in m.weights.items()]
    )
    stores.write_metrics(folder, evaluation.metrics_of(ordered), evaluation.curve_of(ordered, ["model"]), importance)
    stored = stores.read_metrics(t.spark, folder)
    roc = stored["roc"].groupBy("model").agg(
        F.count(F.lit(1)).cast("double").alias("points"), F.sum("tp").cast("double").alias("tp")
    )

    def named(source, df, name):
        return df.select(F.lit(source).alias("source"), "model", F.col(name).alias("name"), "value")

    return (
        named("metrics", rounded(stored["metrics"], 6, "value"), "metric")
        .unionByName(named("roc", roc.unpivot("model", ["points", "tp"], "name", "value"), "name"))
        .unionByName(named("importance", stored["importance"], "feature"))
    )


@query(
    "logistic_fit",
    f"""SELECT unnest([{", ".join(f"'{f}'" for f in (*X.MODEL_FEATURES, "intercept"))}]) AS term, 0e0 AS value
UNION ALL SELECT 'test rows', CAST({TEST_ROWS} AS DOUBLE)
UNION ALL SELECT 'training rows', CAST((SELECT count(*) FROM model_rows) - {TEST_ROWS} AS DOUBLE)""",
    [MODEL_ROWS],
)
def _(t):
    """The gradient of the fitted objective, which is zero at the optimum, and the rows on both sides."""
    trained = modelling.train_models(t.applications, only=(X.LOGISTIC,))
    gradient = modelling.logistic_gradient(trained.split.where("NOT is_test"), trained.linear)
    side = F.when(F.col("is_test"), "test rows").otherwise("training rows").alias("term")
    rows = trained.split.groupBy(side).agg(F.count(F.lit(1)).cast("double").alias("value"))
    # Adding zero turns a negative zero into zero.
    return gradient.withColumn("value", F.round("value", 4) + 0.0).unionByName(rows)


@query(
    "train_and_compare",
    f"""SELECT metric, {TEST_ROWS} AS test_rows, true AS in_range, true AS beats_chance, true AS winner_leads
FROM (VALUES ('auc'), ('precision'), ('recall'), ('f1')) AS v(metric)""",
    [MODEL_ROWS],
)
def _(t):
    """Both models at full size: metrics within their range, AUC above chance, the leader and its margin consistent."""
    trained = modelling.train_models(t.applications)
    predicted = trained.predictions()
    compared = evaluation.compare_models(evaluation.evaluate(predicted), X.LOGISTIC, X.BOOSTED)
    a, b = F.col(X.LOGISTIC), F.col(X.BOOSTED)
    rows = predicted.where(F.col("model") == X.BOOSTED).agg(F.count(F.lit(1)).alias("test_rows"))
    leads = F.when(a > b, F.lit(X.LOGISTIC)).otherwise(F.lit(X.BOOSTED))
    return compared.crossJoin(F.broadcast(rows)).select(
        "metric",
        "test_rows",
        (a.between(0, 1) & b.between(0, 1)).alias("in_range"),
        ((F.col("metric") != "auc") | ((a > 0.52) & (b > 0.52))).alias("beats_chance"),
        F.coalesce((F.col("winner") == leads) & (F.col("margin") == F.abs(a - b)), F.lit(True)).alias("winner_leads"),
    )


@query(
    "importance_comparison",
    f"""SELECT CAST({len(X.MODEL_FEATURES)} AS BIGINT) AS features, true AS ranks_first, true AS ranks_second,
  1e0 AS largest_first, 1e0 AS largest_second, true AS ordered""",
)
def _(t):
    """Ranks are permutations, the largest share is one, shares fall with the first model's rank."""
    trained = modelling.train_models(t.applications)
    compared = modelling.compare_importance(trained.importance, X.LOGISTIC, X.BOOSTED)
    wanted = F.array(*[F.lit(i + 1) for i in range(len(X.MODEL_FEATURES))])
    by_rank = F.array_sort(F.collect_list(F.struct("rank_first", (-F.col("share_first")).alias("share"))))
    fallen = F.transform(by_rank, lambda r: r["share"])
    return compared.agg(
        F.count(F.lit(1)).alias("features"),
        (F.array_sort(F.collect_list("rank_first")) == wanted).alias("ranks_first"),
        (F.array_sort(F.collect_list("rank_second")) == wanted).alias("ranks_second"),
        F.max("share_first").alias("largest_first"),
        F.max("share_second").alias("largest_second"),
        (fallen == F.array_sort(fallen)).alias("ordered"),
    )


@query("agreement_levels", """SELECT agreement, count(*) AS n FROM (SELECT CASE WHEN abs(p - p2) * 100e0 > 10 THEN 'Significant'
  WHEN abs(p - p2) * 100e0 > 5 THEN 'Moderate' ELSE 'Aligned' END AS agreement FROM scored) GROUP BY 1""", [MODEL_ROWS, SCORED])
def _(t):
    out = scoring.compare_predictions(_rows(t), FIRST, SECOND)
    return out.groupBy(labels.agreement(F.col("difference")).alias("agreement")).agg(F.count(F.lit(1)).alias("n"))
