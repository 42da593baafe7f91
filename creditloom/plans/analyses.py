"""Page-level analyses: each bundles the frames one report needs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.functions import labels
from creditloom.operators import (
    distributions,
    drivers,
    evaluation,
    explain,
    frames,
    modelling,
    portfolio,
    sampling,
    segmentation,
)
from creditloom.operators.features import add_derived_features, prepare_model_features
from creditloom.sources.csv import CSV_FILES, export_csv
from creditloom.sources.stores import save_models, write_metrics


def portfolio_overview(applications: DataFrame) -> dict[str, DataFrame]:
    """KPIs, segment rates and capped distributions; KPIs and rates share one scan."""
    with_status = applications.withColumn("status", labels.status())
    kpis = portfolio.overview(applications)
    return {
        "segments": kpis,
        "threshold": kpis.where("dimension = 'all'").select(
            "default_rate_pct", labels.threshold_flag(F.col("default_rate_pct")).alias("flag")
        ),
        "contract_share": portfolio.share_of_total(applications),
        "income": distributions.histogram(
            with_status.where(F.col("AMT_INCOME_TOTAL") <= X.INCOME_CAP), "AMT_INCOME_TOTAL", "status"
        ),
        "credit": distributions.histogram(
            with_status.where(F.col("AMT_CREDIT") <= X.CREDIT_CAP), "AMT_CREDIT", "status"
        ),
    }


def default_drivers(applications: DataFrame, feature: str = "EXT_SOURCE_2") -> dict[str, DataFrame]:
    frame = frames.driver_frame(applications)
    by_status = frames.feature_by_target(applications, feature).withColumn("status", labels.status())
    return {
        "correlation": drivers.target_correlation(frame),
        "density": distributions.density_histogram(by_status, feature, "status"),
        "matrix": drivers.correlation_matrix(add_derived_features(frame), X.HEATMAP),
    }


def risk_segmentation(applications: DataFrame) -> dict[str, DataFrame]:
    tiers, _ = segmentation.segment(applications, stored=True)
    return {
        "summary": segmentation.tier_summary(tiers),
        "rates": segmentation.default_rate_by_tier(tiers),
        "scatter": tiers.select(X.ID, "EXT_SOURCE_AVG", "DEBT_TO_INCOME", "RISK_TIER"),
        "income": distributions.box_stats(tiers, "AMT_INCOME_TOTAL", "RISK_TIER", X.RISK_TIERS),
        "age": distributions.box_stats(tiers, "AGE_YEARS", "RISK_TIER", X.RISK_TIERS),
    }


def sample_dataset(tables: Mapping[str, DataFrame], folder: str, sizes: Mapping[int, int]) -> None:
    """Sample the applications by class, keep their children, write all as CSV that ingest reads."""
    sampled = sampling.stratified_sample(tables["applications"], sizes)
    kept = {name: df if name == "applications" else sampling.subset_children(df, sampled) for name, df in tables.items()}
    for name, df in (kept | {"applications": sampled}).items():
        export_csv(df, f"{folder.rstrip('/')}/{CSV_FILES[name]}")


def train_and_store(applications: DataFrame, folder: str, rounds: int = X.TREE_ROUNDS) -> modelling.Trained:
    """Train both models, judge them on the test rows, write models and metrics."""
    trained = modelling.train_models(applications, rounds)
    ordered = evaluation.ordered_scores(trained.predictions(), by=["model"])
    save_models(trained.models, f"{folder.rstrip('/')}/models")
    write_metrics(
        f"{folder.rstrip('/')}/metrics",
        evaluation.metrics_of(ordered),
        evaluation.curve_of(ordered, ["model"]),
        trained.importance,
    )
    return trained


def model_explanations(applications: DataFrame, trained: modelling.Trained) -> dict[str, DataFrame]:
    """Global importance and per-row data of the linear model over all complete-score rows."""
    frame, _ = prepare_model_features(frames.explainable_rows(applications), impute=False)
    return {
        "importance": explain.global_importance(frame, trained.linear, background=frame),
        "beeswarm": explain.beeswarm(frame, trained.linear, background=frame),
        "texts": explain.explanation_text(explain.linear_attribution(frame, trained.linear)),
    }
