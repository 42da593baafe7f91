"""Classifier quality: threshold metrics, AUC, ROC points, model comparison.

Every function takes a frame with a 0/1 label and a score; ``by`` names the
columns that tell several models apart, so that all are measured in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.fixed import TARGET
from creditloom.functions.scoring import hard_label
from creditloom.operators.ranking import running_totals
from creditloom.session import materialise


def _shares() -> dict[str, Column]:
    """Precision, recall and F1 from the confusion counts; an undefined ratio is 0."""

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(tp * 2, tp * 2 + fp + fn),
    }


def binary_metrics(
    df: DataFrame, label: str = TARGET, score: str = "p", by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Confusion counts, precision, recall and F1; an undefined ratio is 0."""
    predicted = hard_label(F.col(score), threshold)

    def cell(actual: int, said: int) -> Column:
        return F.count_if((F.col(label) == actual) & (predicted == said))

    counts = df.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")
    )
    return counts.withColumns(_shares())


def score_counts(
    df: DataFrame, label: str = TARGET, score: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives per distinct score: tied rows become one row before any ordering."""
    return (
        df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )


def ordered_scores(
    df: DataFrame, label: str = TARGET, score: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """Score counts with running totals: what the AUC, the curve and the threshold metrics rest on.

    The counts are written to the shared folder, so that rows are read and scored
    once however often the result is used.
    """
    return running_totals(materialise(score_counts(df, label, score, by), "score-counts"), "score", ["pos", "neg"], by)


def _wins() -> Column:
    """Correctly ordered (positive, negative) pairs, ties counting half."""
    negatives_below = F.col("neg_upto") - F.col("neg")
    return F.sum(F.col("pos") * (negatives_below + F.col("neg") / 2.0))


def _auc() -> Column:
    return F.try_divide(_wins(), F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def roc_auc(df: DataFrame, label: str = TARGET, score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the
    right order, ties counting half. NULL when a class is missing."""
    return ordered_scores(df, label, score, by).groupBy(*by).agg(_auc().alias("auc"))


def roc_curve(df: DataFrame, label: str = TARGET, score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at or above each distinct threshold, plus the (0, 0) start."""
    return curve_of(ordered_scores(df, label, score, by), by)


def curve_of(ordered: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ROC curve of ordered scores."""
    by = list(by)
    totals = ordered.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    # One row per model.
    joined = ordered.join(F.broadcast(totals), by) if by else ordered.crossJoin(F.broadcast(totals))
    at_or_above = joined.select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("positives") - F.col("pos_upto") + F.col("pos")).alias("tp"),
        (F.col("negatives") - F.col("neg_upto") + F.col("neg")).alias("fp"),
        "positives",
        "negatives",
    )
    start = totals.select(
        *by,
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"),
        "positives",
        "negatives",
    )
    return at_or_above.unionByName(start).select(
        *by,
        "threshold",
        "tp",
        "fp",
        F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.col("negatives")).alias("fpr"),
    )


def metrics_of(ordered: DataFrame, by: Sequence[str] = ("model",), threshold: float = 0.5) -> DataFrame:
    """``(model, metric, value)`` with auc, precision, recall and f1 of ordered scores."""
    keys = list(by)
    above = F.col("score") > threshold
    wide = ordered.groupBy(*keys).agg(
        _auc().alias("auc"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
    )
    return wide.withColumns(_shares()).unpivot(keys, ["auc", "precision", "recall", "f1"], "metric", "value")


def evaluate(df: DataFrame, label: str = TARGET, score: str = "p", by: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics of every model, from one pass over the scores."""
    return metrics_of(ordered_scores(df, label, score, by), by)


def compare_models(
    metrics: DataFrame, first: str, second: str, judged: Sequence[str] = ("auc", "f1")
) -> DataFrame:
    """Metric table of two models with the leader and its margin for the judged metrics.

    A tie goes to the second model.
    """
    wide = metrics.groupBy("metric").pivot("model", [first, second]).agg(F.first("value"))
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    is_judged = F.col("metric").isin(*judged)
    return wide.withColumns(
        {
            "winner": F.when(is_judged, F.when(a > b, first).otherwise(second)),
            "margin": F.when(is_judged, F.abs(a - b)),
        }
    )
