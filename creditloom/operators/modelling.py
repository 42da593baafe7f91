"""Training of the two default classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.functions.scoring import LinearModel
from creditloom.operators.features import collect_moments, medians, prepare_model_features
from creditloom.operators.frames import training_frame
from creditloom.operators.sampling import stratified_split
from creditloom.session import use_checkpoints

# Rows that a partition of a fit has at least, where there are so many, and at most, once all cores have two.
LEAST_ROWS, MOST_ROWS = 25_000, 1_000_000


@dataclass(frozen=True)
class Preprocessor:
    """Training medians, means and population deviations of the features."""

    features: Sequence[str]
    medians: Mapping[str, float]
    moments: Mapping[str, tuple[float, float]]

    def stage(self) -> SQLTransformer:
        """Impute and standardise as one saveable stage of plain expressions."""
        parts = [
            f"(coalesce(CAST(`{f}` AS DOUBLE), {self.medians[f]!r}D) - {self.moments[f][0]!r}D)"
            f" / {float(self.moments[f][1] or 1.0)!r}D AS `z_{f}`"
            for f in self.features
        ]
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")

    def assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=[f"z_{f}" for f in self.features], outputCol="features")


def fit_preprocessor(
    train: DataFrame, features: Sequence[str] = X.MODEL_FEATURES, accuracy: int | None = None
) -> Preprocessor:
    """Exact medians, then moments of the imputed columns; three numbers per feature."""
    middle = medians(train, features, accuracy)
    missing = [f for f in features if middle[f] is None]
    if missing:
        raise ValueError(f"no training value for {missing}")
    middle = {f: float(v) for f, v in middle.items()}
    filled = train.select(*[F.coalesce(F.col(f).cast("double"), F.lit(middle[f])).alias(f) for f in features])
    return Preprocessor(list(features), middle, collect_moments(filled, features))


def class_counts(train: DataFrame, label: str = X.TARGET) -> tuple[int, int]:
    row = train.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if not row[0] or not row[1]:
        raise ValueError("training needs both classes")
    return row[0], row[1]


def balanced_weights(df: DataFrame, label: str = X.TARGET, name: str = "weight") -> DataFrame:
    """Add ``n / (2 * n_class)``. The class counts are one broadcast row."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1")
    )
    n = (F.col("_n0") + F.col("_n1")).cast("double")
    weight = F.when(F.col(label) == 1, F.try_divide(n, F.col("_n1") * 2.0)).when(
        F.col(label) == 0, F.try_divide(n, F.col("_n0") * 2.0)
    )
    return df.crossJoin(F.broadcast(counts)).withColumn(name, weight).select(*df.columns, name)


def _parts(rows: int, cores: int) -> int:
    """Partitions for a fit: enough for all cores if there are rows for them, and of a bounded size."""
    return max(1, min(-(-rows // LEAST_ROWS), max(2 * cores, -(-rows // MOST_ROWS))))


def _vectors(train: DataFrame, prep: Preprocessor, weight, label: str, rows: int) -> DataFrame:
    """Label, weight and features, dealt out evenly: a fit passes over them hundreds of times.

    As read, they have as many partitions as the files have row groups.
    """
    dealt = train.repartition(_parts(rows, train.sparkSession.sparkContext.defaultParallelism), *train.columns)
    staged = prep.assembler().transform(prep.stage().transform(dealt))
    return staged.select(
        F.col(label).cast("double").alias("label"), weight.alias("weight"), "features"
    )


def fit_logistic(
    train: DataFrame,
    prep: Preprocessor,
    label: str = X.TARGET,
    c: float = X.LOGISTIC_C,
    max_iter: int = X.LOGISTIC_ITERATIONS,
) -> PipelineModel:
    """L2 logistic regression with balanced classes.

    ``C`` weighs the summed loss against the penalty; Spark averages the loss
    over the total weight, which balancing makes equal to the row count, so
    ``regParam = 1 / (C * n)``.
    """
    n0, n1 = class_counts(train, label)
    n = n0 + n1
    weight = F.when(F.col(label) == 1, F.lit(n / (2.0 * n1))).otherwise(F.lit(n / (2.0 * n0)))
    vectors = _vectors(train, prep, weight, label, n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = LogisticRegression(
            regParam=1.0 / (c * n),
            elasticNetParam=0.0,
            standardization=False,
            weightCol="weight",
            maxIter=max_iter,
            tol=1e-9,
        ).fit(vectors)
    finally:
        vectors.unpersist()
    # The training summary holds the session, which can't go to tasks with the model once a query of it was observed.
    model._call_java("setSummary", train.sparkSession._jvm.scala.Option.apply(None))
    return PipelineModel([prep.stage(), prep.assembler(), model])


def logistic_gradient(
    train: DataFrame, model: LinearModel, label: str = X.TARGET, c: float = X.LOGISTIC_C
) -> DataFrame:
    """``(term, value)``: the gradient of the balanced, penalised objective at ``model``.

    Zero for every term at the optimum.
    """
    weighted = balanced_weights(train, label)
    error = F.col("weight") * (model.probability() - F.col(label))
    terms = {f: F.sum(error * model.z(f)) / F.count(F.lit(1)) for f in model.features}
    rows = weighted.agg(
        *[v.alias(f) for f, v in terms.items()],
        (F.sum(error) / F.count(F.lit(1))).alias("intercept"),
        F.count(F.lit(1)).alias("_n"),
    )
    pulled = [(F.col(f) + F.lit(w / c) / F.col("_n")).alias(f) for f, w in model.weights.items()]
    return rows.select(*pulled, "intercept").unpivot([], [*model.features, "intercept"], "term", "value")


def fit_boosted_trees(
    train: DataFrame,
    prep: Preprocessor,
    label: str = X.TARGET,
    rounds: int = X.TREE_ROUNDS,
    depth: int = X.TREE_DEPTH,
    step: float = X.TREE_STEP,
    seed: int = X.SEED,
) -> PipelineModel:
    """Boosted trees with positives weighted by negatives / positives."""
    use_checkpoints(train.sparkSession)
    n0, n1 = class_counts(train, label)
    weight = F.when(F.col(label) == 1, F.lit(n0 / n1)).otherwise(F.lit(1.0))
    vectors = _vectors(train, prep, weight, label, n0 + n1).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = GBTClassifier(
            maxIter=rounds, maxDepth=depth, stepSize=step, weightCol="weight", seed=seed, checkpointInterval=10
        ).fit(vectors)
    finally:
        vectors.unpersist()
    return PipelineModel([prep.stage(), prep.assembler(), model])


def linear_model(fitted: PipelineModel, prep: Preprocessor) -> LinearModel:
    """The fitted logistic pipeline as plain numbers, for SQL scoring and explanation."""
    classifier = fitted.stages[-1]
    return LinearModel(
        weights={f: float(w) for f, w in zip(prep.features, classifier.coefficients, strict=True)},
        intercept=float(classifier.intercept),
        medians=dict(prep.medians),
        moments=dict(prep.moments),
    )


def importances(model: str, fitted: PipelineModel, features: Sequence[str]) -> list[tuple[str, str, float]]:
    """``(model, feature, value)``: absolute coefficients or tree gains."""
    classifier = fitted.stages[-1]
    values = getattr(classifier, "coefficients", None)
    if values is None:
        values = classifier.featureImportances
    return [(model, f, abs(float(v))) for f, v in zip(features, values.toArray(), strict=True)]


def importance_frame(spark, rows: Sequence[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "model string, feature string, value double")


def compare_importance(importance: DataFrame, first: str, second: str, top: int = 3) -> DataFrame:
    """Importances scaled by each model's largest, in the first model's order.

    Adds each model's rank, and ``top_differs``: whether the two top lists differ.
    """
    norm = F.try_divide(F.col("value"), F.max("value").over(Window.partitionBy("model")))
    order = Window.partitionBy("model").orderBy(F.desc("value"), "feature")
    ranked = importance.select(
        "model", "feature", norm.alias("share"), F.row_number().over(order).alias("rank")
    )

    def of(model: str, suffix: str) -> DataFrame:
        return ranked.where(F.col("model") == model).select(
            "feature", F.col("share").alias(f"share_{suffix}"), F.col("rank").alias(f"rank_{suffix}")
        )

    both = of(first, "first").join(of(second, "second"), "feature")
    moved = (F.least("rank_first", "rank_second") <= top) & (F.col("rank_first") != F.col("rank_second"))
    return both.withColumn("top_differs", F.bool_or(moved).over(Window.partitionBy())).orderBy("rank_first")


@dataclass(frozen=True)
class Trained:
    """The fitted pipelines with what is needed to explain and judge them."""

    prep: Preprocessor
    models: Mapping[str, PipelineModel]
    linear: LinearModel | None
    split: DataFrame
    importance: DataFrame

    def predictions(self) -> DataFrame:
        """Test rows scored by every model: ``(model, key, label, p)``."""
        from creditloom.operators.scoring import predict_all

        return predict_all(self.split.where("is_test"), dict(self.models))


def train_models(
    applications: DataFrame,
    rounds: int = X.TREE_ROUNDS,
    accuracy: int | None = None,
    only: Sequence[str] = (X.LOGISTIC, X.BOOSTED),
) -> Trained:
    """Split, preprocess and fit the classifiers on the training rows.

    ``only`` names the models to fit; without the logistic one there is no
    linear model to explain.
    """
    prepared, features = prepare_model_features(training_frame(applications), impute=False)
    split = stratified_split(prepared.select(X.ID, X.TARGET, *features))
    train = split.where(~F.col("is_test")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prep = fit_preprocessor(train, features, accuracy)
    finally:
        # The fits keep their own vectors; one copy of the training rows at a time.
        train.unpersist()
    models = {}
    if X.LOGISTIC in only:
        models[X.LOGISTIC] = fit_logistic(train, prep)
    if X.BOOSTED in only:
        models[X.BOOSTED] = fit_boosted_trees(train, prep, rounds=rounds)
    rows = [r for name, m in models.items() for r in importances(name, m, features)]
    return Trained(
        prep,
        models,
        linear_model(models[X.LOGISTIC], prep) if X.LOGISTIC in models else None,
        split,
        importance_frame(applications.sparkSession, rows),
    )
