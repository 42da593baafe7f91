"""Fits, evaluation, persistence and explanation."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from checks.constants import FIRST
from creditloom import fixed as X
from creditloom.operators import evaluation, explain, frames, modelling, scoring
from creditloom.operators.features import prepare_model_features
from creditloom.sources import stores, versions


@pytest.fixture(scope="module")
def trained(tables):
    return modelling.train_models(tables.applications, rounds=3)


@pytest.fixture(scope="module")
def train_arrays(trained):
    staged = trained.prep.stage().transform(trained.split.where("NOT is_test"))
    pdf = staged.select(X.TARGET, *[f"z_{f}" for f in X.MODEL_FEATURES]).toPandas()
    return pdf[[f"z_{f}" for f in X.MODEL_FEATURES]].to_numpy(), pdf[X.TARGET].to_numpy()


def test_preprocessor_standardises_the_training_rows(train_arrays):
    z, _ = train_arrays
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(z.std(axis=0), 1, atol=1e-9)


def test_logistic_fit_is_optimal(trained, train_arrays):
    """The gradient of the weighted, penalised loss vanishes at the fitted point."""
    z, y = train_arrays
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    beta = np.array(list(trained.linear.weights.values()))
    p = 1 / (1 + np.exp(-(trained.linear.intercept + z @ beta)))
    gradient = z.T @ (weight * (p - y)) + beta / X.LOGISTIC_C
    assert np.abs(gradient).max() < 1e-2 * n**0.5
    assert abs((weight * (p - y)).sum()) < 1e-2 * n**0.5


def test_linear_model_scores_like_the_fitted_pipeline(trained):
    test = trained.split.where("is_test")
    by_pipeline = scoring.predict_proba(test, trained.models[X.LOGISTIC]).withColumnRenamed("p", "a")
    both = scoring.predict_proba(by_pipeline.drop("prediction"), trained.linear)
    assert both.agg(F.max(F.abs(F.col("a") - F.col("p")))).first()[0] < 1e-9


def test_models_score_in_a_session_that_observed(spark, trained):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get["rows"] == 3
    test = trained.split.where("is_test")
    for model in trained.models.values():
        assert scoring.predict_proba(test, model).agg(F.count("p")).first()[0] == test.count()
    assert not trained.models[X.LOGISTIC].stages[-1].hasSummary


def test_models_beat_chance(trained):
    for r in evaluation.roc_auc(trained.predictions(), by=["model"]).collect():
        assert r["auc"] > 0.52, r


def test_store_and_load(spark, trained, tmp_path):
    folder = str(tmp_path / "models")
    assert stores.load_model(spark, folder) is None
    stores.save_models(trained.models, folder)
    test = trained.split.where("is_test")
    for name in (X.LOGISTIC, X.BOOSTED):
        loaded = stores.load_model(spark, folder, name)
        a = scoring.predict_proba(test, trained.models[name]).select(X.ID, F.col("p").alias("a"))
        b = scoring.predict_proba(test, loaded).select(X.ID, "p")
        assert a.join(b, X.ID).where("a <> p").count() == 0
    # An unknown model falls back to the default scorer.
    fallback = stores.load_model(spark, folder, "absent")
    assert np.allclose(fallback.stages[-1].coefficients, list(trained.linear.weights.values()))
    # A save that breaks off changes nothing; a model that was altered is refused.
    with pytest.raises(ValueError):
        stores.save_models({X.BOOSTED: trained.models[X.BOOSTED]}, folder)
    assert stores.load_model(spark, folder) is not None
    version = versions.current(spark, folder)
    trained.models[X.BOOSTED].write().overwrite().save(f"{version}/{X.LOGISTIC}")
    with pytest.raises(stores.AlteredModel):
        stores.load_model(spark, folder)


def test_metrics_of_a_broken_store_are_those_before(spark, trained, tmp_path):
    """The three tables are one unit: a writer that fails at the second leaves all three as they were."""
    folder = str(tmp_path / "metrics")
    metrics = spark.createDataFrame([("a", "auc", 0.7)], "model string, metric string, value double")
    stores.write_metrics(folder, metrics, metrics, metrics)
    broken = metrics.withColumn("value", F.raise_error(F.lit("stopped half-way")).cast("double"))
    newer = metrics.withColumn("value", F.lit(0.9))
    with pytest.raises(Exception, match="half-way"):
        stores.write_metrics(folder, newer, broken, newer)
    assert [r["value"] for n in stores.METRIC_TABLES for r in stores.read_metrics(spark, folder)[n].collect()] == [0.7] * 3


def test_metrics_store(spark, trained, tmp_path):
    folder = str(tmp_path / "metrics")
    assert stores.read_metrics(spark, folder) is None
    scored = trained.predictions()
    stores.write_metrics(folder, evaluation.evaluate(scored), evaluation.roc_curve(scored, by=["model"]), trained.importance)
    back = stores.read_metrics(spark, folder)
    assert back["metrics"].count() == 8
    assert back["roc"].where("tpr = 1 AND fpr = 1").select("model").distinct().count() == 2
    compared = modelling.compare_importance(back["importance"], X.LOGISTIC, X.BOOSTED).collect()
    assert [r["rank_first"] for r in compared] == list(range(1, 11))
    assert compared[0]["share_first"] == 1.0 and len({r["top_differs"] for r in compared}) == 1


def test_smoke_borrower(spark, trained):
    form = spark.createDataFrame([X.SMOKE_BORROWER])
    row = frames.application_inputs(form)
    assert row.first()["DAYS_BIRTH"] == -12775 and row.first()["DEBT_TO_INCOME"] == 500000 / 200001
    for name in (X.LOGISTIC, X.BOOSTED):
        out = scoring.score(row, dict(trained.models), name).first()
        assert 0 < out["p"] < 1 and out["risk_band"] in X.RISK_TIERS and out["model"] == name
    with pytest.raises(ValueError):
        scoring.score(row, dict(trained.models), "absent")


def test_single_class_training_fails(spark, trained):
    with pytest.raises(ValueError, match="both classes"):
        modelling.fit_logistic(trained.split.where("TARGET = 0"), trained.prep)


def scores(spark, rows):
    return spark.createDataFrame(rows, "TARGET int, p double")


def test_auc_of_ties_and_missing_classes(spark):
    def auc(rows):
        return evaluation.roc_auc(scores(spark, rows)).first()["auc"]

    assert auc([(1, 0.5), (0, 0.5), (0, 0.5)]) == 0.5
    assert auc([(1, 0.9), (0, 0.1)]) == 1.0
    assert auc([(1, 0.1), (0, 0.9), (1, None), (None, 0.2)]) == 0.0
    assert auc([(1, 0.1), (1, 0.9)]) is None


def test_auc_against_brute_force_and_monotone_transform(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400) * 0.7 + y * 0.2, 2)
    df = scores(spark, [(int(a), float(b)) for a, b in zip(y, p)]).repartition(5)
    wins = (p[y == 1][:, None] > p[y == 0]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0]).sum()
    want = wins / ((y == 1).sum() * (y == 0).sum())
    assert evaluation.roc_auc(df).first()["auc"] == pytest.approx(want)
    shifted = df.withColumn("p", F.exp(F.col("p") * 3) - 100)
    assert evaluation.roc_auc(shifted).first()["auc"] == pytest.approx(want)
    curve = evaluation.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert (curve[0]["tp"], curve[0]["fp"]) == (0, 0) and curve[-1]["tpr"] == curve[-1]["fpr"] == 1.0
    x, t = np.array([r["fpr"] for r in curve]), np.array([r["tpr"] for r in curve])
    assert ((x[1:] - x[:-1]) * (t[1:] + t[:-1]) / 2).sum() == pytest.approx(want)


def test_metrics_when_nothing_is_predicted(spark):
    row = evaluation.binary_metrics(scores(spark, [(1, 0.5), (0, 0.2), (0, None)])).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 0, 1, 1)
    assert row["precision"] == row["recall"] == row["f1"] == 0.0


def test_comparison_ties_go_to_the_second(spark):
    m = spark.createDataFrame(
        [("a", "auc", 0.7), ("b", "auc", 0.7), ("a", "f1", 0.4), ("b", "f1", 0.3), ("a", "recall", 1.0), ("b", "recall", 0.0)],
        "model string, metric string, value double",
    )
    got = {r["metric"]: (r["winner"], r["margin"]) for r in evaluation.compare_models(m, "a", "b").collect()}
    assert got["auc"] == ("b", 0.0) and got["recall"] == (None, None)
    assert got["f1"][0] == "a" and got["f1"][1] == pytest.approx(0.1)


def model_rows(tables):
    return prepare_model_features(frames.training_frame(tables.applications), impute=False)[0]


def test_contributions_add_up(tables):
    rows = model_rows(tables)
    for background in (None, rows):
        gap = explain.additivity(explain.linear_attribution(rows, FIRST, background)).first()
        assert gap["rows"] == 1500 and gap["max_gap"] < 1e-9
        if background is not None:
            assert gap["base"] == pytest.approx(gap["mean_logit"])


def test_row_equal_to_the_background_has_no_contributions(tables):
    one = model_rows(tables).limit(1)
    long = explain.attribution_long(explain.linear_attribution(one, FIRST, one))
    assert long.agg(F.max(F.abs("phi"))).first()[0] == 0.0
    explained = explain.explain_rows(explain.linear_attribution(one, FIRST, one)).first()
    assert explained["increasing"] == [] and explained["decreasing"] == []
    texts = explain.explanation_text(explain.linear_attribution(one, FIRST, one)).first()
    assert texts["increasing_text"] == "" and texts["decreasing_text"] == ""


def test_factors_at_the_limit_and_ties(spark):
    from creditloom.functions.scoring import LinearModel

    model = LinearModel({"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0}, 0.0)
    df = spark.createDataFrame([(1, 0.01, 0.5, 0.5, 0.5, 0.5), (2, -0.01, -0.02, 0.0, 3.0, -1.0)], "SK_ID_CURR long, a double, b double, c double, d double, e double")
    got = explain.top_factors(explain.linear_attribution(df, model)).collect()
    found = {(r["SK_ID_CURR"], r["side"], r["rank"]): r["feature"] for r in got}
    assert found == {
        (1, "increasing", 1): "b",
        (1, "increasing", 2): "c",
        (1, "increasing", 3): "d",
        (2, "increasing", 1): "d",
        (2, "decreasing", 1): "e",
        (2, "decreasing", 2): "b",
    }
    steps = explain.waterfall(explain.linear_attribution(df, model)).where("SK_ID_CURR = 2").orderBy("step").collect()
    assert [s["feature"] for s in steps] == ["d", "e", "b", "a", "c", "Prediction"]
    assert steps[-1]["end"] == pytest.approx(1.97)
    for a, b in zip(steps[:-2], steps[1:-1]):
        assert a["end"] == b["start"]


def test_beeswarm_of_a_constant_feature(spark):
    from creditloom.functions.scoring import LinearModel

    model = LinearModel({"a": 2.0, "b": 1.0}, 0.0)
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 4.0, 5.0)], "SK_ID_CURR long, a double, b double")
    got = {(r["SK_ID_CURR"], r["feature"]): (r["color"], r["rank"]) for r in explain.beeswarm(df, model).collect()}
    assert got == {(1, "a"): (0.0, 2), (2, "a"): (1.0, 2), (1, "b"): (0.0, 1), (2, "b"): (0.0, 1)}


def test_fits_deal_their_rows_out(trained, monkeypatch):
    """Rows from one row group still work on all cores, and a partition's size is bounded."""
    assert [modelling._parts(n, 8) for n in (0, 100, 60_000, 900_000, 50_000_000)] == [1, 1, 3, 16, 50]
    monkeypatch.setattr(modelling, "LEAST_ROWS", 1000)
    train = trained.split.where("NOT is_test").coalesce(1)
    rows = train.count()
    vectors = modelling._vectors(train, trained.prep, F.lit(1.0), X.TARGET, rows)
    sizes = [r["n"] for r in vectors.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == modelling._parts(rows, train.sparkSession.sparkContext.defaultParallelism) > 1
    assert sum(sizes) == rows and max(sizes) < 2 * rows / len(sizes)
