"""Batch scoring, risk bands, rule-based risk factors, model agreement."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.functions import labels, text
from creditloom.functions.features import mean_present
from creditloom.functions.scoring import LinearModel, hard_label

INPUT_SCORES = tuple(c.lower() for c in X.SCORES)


def predict_proba(df: DataFrame, model: LinearModel | PipelineModel) -> DataFrame:
    """Add ``p`` (probability of default) and ``prediction`` (at 0.5)."""
    if isinstance(model, LinearModel):
        scored = df.withColumn("p", model.probability())
    else:
        p = vector_to_array(F.col("probability"))[1]
        scored = model.transform(df).select(*df.columns, p.alias("p"))
    return scored.withColumn("prediction", hard_label(F.col("p")))


def score(df: DataFrame, models: dict[str, LinearModel | PipelineModel], model: str = X.LOGISTIC) -> DataFrame:
    """Probability, hard label, band and gauge from the chosen model."""
    if model not in models:
        raise ValueError(f"unknown model '{model}', have {sorted(models)}")
    p = F.col("p")
    return predict_proba(df, models[model]).withColumns(
        {"risk_band": labels.risk_band(p), "gauge": labels.gauge(p), "model": F.lit(model)}
    )


def compare_predictions(
    df: DataFrame, first: LinearModel | PipelineModel, second: LinearModel | PipelineModel
) -> DataFrame:
    """Both probabilities per row with their agreement."""
    a = predict_proba(df, first).withColumnRenamed("p", "p_first").drop("prediction")
    b = predict_proba(a, second).withColumnRenamed("p", "p_second").drop("prediction")
    return model_agreement(b, "p_first", "p_second")


def predict_all(
    df: DataFrame, models: dict[str, LinearModel | PipelineModel], key: str = X.ID, label: str = X.TARGET
) -> DataFrame:
    """Every row scored by every model, as ``(model, key, label, p)``, in one pass over the rows."""
    scored = df
    for i, model in enumerate(models.values()):
        scored = predict_proba(scored, model).withColumnRenamed("p", f"_p_{i}").drop("prediction")
    found = [F.struct(F.lit(n).alias("model"), F.col(f"_p_{i}").alias("p")) for i, n in enumerate(models)]
    return scored.select(key, label, F.inline(F.array(*found))).select("model", key, label, "p")


def model_agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Add ``difference`` in percentage points and the ``agreement`` level."""
    return df.withColumn("difference", F.abs(F.col(first) - F.col(second)) * 100.0).withColumn(
        "agreement", labels.agreement(F.col("difference"))
    )


def _rules() -> list[Column]:
    """The rule set over form inputs, each rule a nullable (factor, effect, text)."""
    scores = mean_present(INPUT_SCORES)
    # Unlike the model's ratios these divide by the bare income.
    debt = F.try_divide(F.col("loan_amount"), F.col("income"))
    annuity = F.try_divide(F.col("annuity"), F.col("income"))
    age, employed = F.col("age"), F.col("employed_years")

    def says(factor: str, effect: str, *parts: Column | str) -> Column:
        message = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.struct(F.lit(factor).alias("factor"), F.lit(effect).alias("effect"), message.alias("text"))

    def around(number: Column, frame: tuple[str, str]) -> tuple[Column | str, ...]:
        return (frame[0], number, frame[1])

    debt_text = text.fixed(debt, 1)
    return [
        F.when(scores < 0.3, says("scores", "[-]", X.LOW_SCORES)).when(
            scores > 0.6, says("scores", "+", X.HIGH_SCORES)
        ),
        F.when(debt > 5, says("debt", "[-]", *around(debt_text, X.HIGH_DEBT))).when(
            debt < 2, says("debt", "+", *around(debt_text, X.LOW_DEBT))
        ),
        F.when(age < 25, says("age", "[~]", X.YOUNG)).when(age > 45, says("age", "+", X.MATURE)),
        F.when(employed < 1, says("employment", "[-]", X.SHORT_EMPLOYMENT)).when(
            employed > 5, says("employment", "+", X.STABLE_EMPLOYMENT)
        ),
        F.when(annuity > 0.3, says("annuity", "[-]", *around(text.percent(annuity), X.HIGH_ANNUITY))),
    ]


def _applied(inputs: DataFrame) -> tuple[DataFrame, Column]:
    """The rules as columns, and the array of all of them with the 'balanced' note last."""
    names = [f"_rule_{i}" for i in range(len(_rules()))]
    note = F.struct(F.lit("balanced").alias("factor"), F.lit("").alias("effect"), F.lit(X.BALANCED).alias("text"))
    balanced = F.when(F.coalesce(*names).isNull(), note)
    return inputs.withColumns(dict(zip(names, _rules(), strict=True))), F.array(*names, balanced)


def risk_factors(inputs: DataFrame) -> DataFrame:
    """Add ``factors``: the rules that apply, in rule order, or the one 'balanced' note."""
    ruled, entries = _applied(inputs)
    return ruled.select(*inputs.columns, F.array_compact(entries).alias("factors"))


def risk_factors_long(inputs: DataFrame, key: str = X.ID) -> DataFrame:
    """One row per borrower and applying rule; ``position`` is the rule's number."""
    ruled, entries = _applied(inputs)
    return (
        ruled.select(key, F.posexplode(entries).alias("position", "f"))
        .where(F.col("f").isNotNull())
        .select(key, "position", "f.*")
    )


def input_summary(inputs: DataFrame, key: str = X.ID) -> DataFrame:
    """The form inputs and both bare ratios, formatted for people, as ``(key, parameter, value)``."""
    debt = F.try_divide(F.col("loan_amount"), F.col("income"))
    annuity = F.try_divide(F.col("annuity"), F.col("income"))

    def years(c: str) -> Column:
        return F.concat(text.fixed(F.col(c), 0), F.lit(" years"))

    # Parameter names of the input summary.
    shown = {
        "Annual Income": text.money(F.col("income")),
        "Loan Amount": text.money(F.col("loan_amount")),
        "Annual Payment": text.money(F.col("annuity")),
        "Age": years("age"),
        "Years Employed": years("employed_years"),
        "Bureau Score 1": text.fixed(F.col("ext_source_1"), 2),
        "Bureau Score 2": text.fixed(F.col("ext_source_2"), 2),
        "Bureau Score 3": text.fixed(F.col("ext_source_3"), 2),
        "Debt-to-Income": text.times(debt, 2),
        "Annuity-to-Income": text.percent(annuity),
    }
    entries = [F.struct(F.lit(n).alias("parameter"), v.alias("value")) for n, v in shown.items()]
    return inputs.select(key, F.inline(F.array(*entries)))
