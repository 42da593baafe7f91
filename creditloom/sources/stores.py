"""Fitted models and their metrics on shared storage.

Models are published together, and so are the three metric tables, so that no
reader mixes two trainings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from creditloom.fixed import LOGISTIC, SMOKE_BORROWER
from creditloom.operators.frames import application_inputs
from creditloom.operators.scoring import predict_proba
from creditloom.sources import versions

METRIC_TABLES = ("metrics", "roc", "importance")
#: Saved and loaded scores of one borrower differ by less.
_SAME = 1e-9


class AlteredModel(ValueError):
    """A loaded model does not score the known borrower as it did when it was saved."""


def smoke_score(spark: SparkSession, model: PipelineModel) -> float:
    """The probability of default that a model gives the fixed borrower."""
    inputs = application_inputs(spark.createDataFrame([SMOKE_BORROWER]))
    return float(predict_proba(inputs, model).first()["p"])


def save_models(models: Mapping[str, PipelineModel], folder: str, default: str = LOGISTIC) -> None:
    """Publish the models as one version, with the fixed borrower's score by each and the default scorer's name."""
    spark = SparkSession.active()
    scores = {name: smoke_score(spark, model) for name, model in models.items()}
    if default not in models:
        raise ValueError(f"the default scorer {default} is not among the models")

    def write(path: str) -> dict:
        for name, model in models.items():
            model.write().save(f"{path}/{name}")
        return {"default": default, "scores": scores}

    versions.publish(spark, folder, write)


def load_model(spark: SparkSession, folder: str, name: str = LOGISTIC) -> PipelineModel | None:
    """The named model, else the default scorer, else None.

    The model has to score the fixed borrower as it did when it was saved.
    """
    version = versions.current(spark, folder)
    if version is None:
        return None
    told = versions.manifest(spark, version)
    chosen = name if name in told["scores"] else told["default"]
    model = PipelineModel.load(f"{version}/{chosen}")
    score = smoke_score(spark, model)
    if not abs(score - told["scores"][chosen]) < _SAME:
        raise AlteredModel(f"{chosen} scores {score} and scored {told['scores'][chosen]} when it was saved")
    return model


def write_metrics(folder: str, metrics: DataFrame, roc: DataFrame, importance: DataFrame) -> None:
    """Publish ``(model, metric, value)``, ROC points and importances as one version of three Parquet tables."""

    def write(path: str) -> dict:
        for name, df in zip(METRIC_TABLES, (metrics, roc, importance), strict=True):
            df.write.parquet(f"{path}/{name}")
        return {"tables": list(METRIC_TABLES)}

    versions.publish(metrics.sparkSession, folder, write)


def read_metrics(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The three tables of the published version, or None when none was published."""
    version = versions.current(spark, folder)
    return None if version is None else {n: spark.read.parquet(f"{version}/{n}") for n in METRIC_TABLES}
