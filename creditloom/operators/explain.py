"""Additive explanations of the linear model.

A row's contributions live in one array column, so ordering them, picking the
strongest and adding them up needs no shuffle at all. The array has one entry
per feature, so it is taken apart by index: plain expressions that stay inside
generated code, unlike lambdas over the array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.fixed import DISPLAY_NAMES, FACTOR_MIN_PHI, FACTORS_PER_SIDE, ID
from creditloom.functions import text
from creditloom.functions.scoring import LinearModel


def background_means(df: DataFrame, model: LinearModel) -> DataFrame:
    """One row with the mean standardised value of every feature over all rows."""
    return df.agg(*[F.avg(model.z(f)).alias(f"bg_{f}") for f in model.features])


def linear_attribution(
    df: DataFrame, model: LinearModel, background: DataFrame | None = None, key: str = ID
) -> DataFrame:
    """``(key, base, logit, contributions)`` per row.

    ``contributions`` is an array of ``(position, feature, value, z, phi)`` with
    ``phi = weight * (z - background)`` in log-odds; ``base + sum(phi) = logit``.
    The background is the frame whose mean counts as neutral; without one it is
    the training mean, where every z is 0.
    """
    base = F.lit(float(model.intercept))
    if background is not None:
        df = df.crossJoin(F.broadcast(background_means(background, model)))
        for f, w in model.weights.items():
            base = base + F.lit(float(w)) * F.col(f"bg_{f}")

    def neutral(f: str) -> Column | None:
        return None if background is None else F.col(f"bg_{f}")

    # In steps, each using the columns of the one before: short expressions
    # make generated methods the JVM will compile.
    features = model.features
    standardised = df.select(
        key,
        base.alias("base"),
        *[F.col(f).cast("double").alias(f) for f in features],
        *[F.col(f"bg_{f}") for f in features if background is not None],
        *[model.z(f).alias(f"z_{f}") for f in features],
    )
    weighed = standardised.select(
        key,
        "base",
        *features,
        *[f"z_{f}" for f in features],
        model.logit(lambda f: F.col(f"z_{f}")).alias("logit"),
        *[model.contribution(f, neutral(f), F.col(f"z_{f}")).alias(f"phi_{f}") for f in features],
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f).alias("feature"),
            F.col(f).alias("value"),
            F.col(f"z_{f}").alias("z"),
            F.col(f"phi_{f}").alias("phi"),
        )
        for i, f in enumerate(features)
    ]
    return weighed.select(
        key, "base", "logit", F.array(*entries).alias("contributions", metadata={"features": list(features)})
    )


def attribution_long(attributed: DataFrame, key: str = ID) -> DataFrame:
    return attributed.select(key, "base", F.inline("contributions"))


def _entries(attributed: DataFrame) -> list[Column]:
    """The contributions one by one; their features are part of the column's metadata."""
    return [F.col("contributions")[i] for i in range(len(_features(attributed)))]


def _features(attributed: DataFrame) -> list[str]:
    return attributed.schema["contributions"].metadata["features"]


def additivity(attributed: DataFrame) -> DataFrame:
    """Rows, mean base, and the largest gap between ``base + sum(phi)`` and the logit."""
    total = sum((c["phi"] for c in _entries(attributed)), F.lit(0.0))
    return attributed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("base").alias("base"),
        F.avg("logit").alias("mean_logit"),
        F.max(F.abs(F.col("base") + total - F.col("logit"))).alias("max_gap"),
    )


def _mean_abs_phi(df: DataFrame, model: LinearModel, background: DataFrame | None) -> DataFrame:
    """``(feature, mean_abs_phi)`` in one aggregate over plain columns."""
    neutral = {}
    if background is not None:
        df = df.crossJoin(F.broadcast(background_means(background, model)))
        neutral = {f: F.col(f"bg_{f}") for f in model.features}
    strength = [F.avg(F.abs(model.contribution(f, neutral.get(f)))).alias(f) for f in model.features]
    return df.agg(*strength).unpivot([], model.features, "feature", "mean_abs_phi")


def display_name(feature: Column) -> Column:
    names = F.create_map(*[F.lit(part) for pair in DISPLAY_NAMES.items() for part in pair])
    return F.coalesce(F.try_element_at(names, feature), feature)


def global_importance(
    df: DataFrame, model: LinearModel, background: DataFrame | None = None, top: int | None = None
) -> DataFrame:
    """Mean absolute contribution per feature, ranked; ``top`` keeps the strongest."""
    # The window sees one row per feature.
    order = Window.partitionBy().orderBy(F.desc("mean_abs_phi"), "feature")
    ranked = _mean_abs_phi(df, model, background).select(
        "feature", display_name(F.col("feature")).alias("name"), "mean_abs_phi", F.row_number().over(order).alias("rank")
    )
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def explain_rows(attributed: DataFrame, k: int = FACTORS_PER_SIDE, min_phi: float = FACTOR_MIN_PHI) -> DataFrame:
    """Add ``increasing`` and ``decreasing``: up to ``k`` clear factors each, strongest first."""

    def side(sign: float) -> Column:
        # Entries that do not qualify are NULL, which a descending sort puts last.
        strength = [c["phi"] * F.lit(sign) for c in _entries(attributed)]
        ranked = F.sort_array(
            F.array(
                *[
                    F.when(
                        x > min_phi,
                        F.struct(
                            x.alias("strength"),
                            (-c["position"]).alias("order"),
                            c["feature"].alias("feature"),
                            c["value"].alias("value"),
                            c["phi"].alias("phi"),
                            F.lit(DISPLAY_NAMES.get(f, f)).alias("name"),
                            F.lit(_value_kind(f)).alias("kind"),
                        ),
                    )
                    for x, c, f in zip(strength, _entries(attributed), _features(attributed), strict=True)
                ]
            ),
            asc=False,
        )
        clear = sum((F.when(x > min_phi, 1).otherwise(0) for x in strength), F.lit(0))
        return F.slice(ranked, F.lit(1), F.least(clear, F.lit(k)))

    return attributed.withColumns({"increasing": side(1.0), "decreasing": side(-1.0)})


def top_factors(attributed: DataFrame, key: str = ID, k: int = FACTORS_PER_SIDE) -> DataFrame:
    """Long form of ``explain_rows``: ``(key, side, rank, feature, value, phi)``."""
    both = F.array(
        *[F.struct(F.lit(n).alias("side"), F.col(n).alias("found")) for n in ("increasing", "decreasing")]
    )
    return (
        explain_rows(attributed, k)
        .select(key, F.inline(both))
        .select(key, "side", F.posexplode("found").alias("i", "c"))
        .select(key, "side", (F.col("i") + 1).alias("rank"), "c.feature", "c.value", "c.phi")
    )


MONEY, YEARS, PLAIN = "money", "years", "plain"


def _value_kind(feature: str) -> str:
    """How people write the values of a feature."""
    if feature == "AMT_INCOME_TOTAL":
        return MONEY
    return YEARS if feature in ("DAYS_BIRTH", "DAYS_EMPLOYED") else PLAIN


def value_text(kind: Column, value: Column) -> Column:
    """A raw value as people write it: money, years or two digits."""
    return (
        F.when(kind == MONEY, text.money(value))
        .when(kind == YEARS, text.years_of_days(value))
        .otherwise(text.fixed(value, 2))
    )


def explanation_text(attributed: DataFrame, key: str = ID, k: int = FACTORS_PER_SIDE) -> DataFrame:
    """``(key, increasing_text, decreasing_text)``: "name (value): +phi" joined by "; "."""

    def sentence(c: Column) -> Column:
        return F.concat(
            c["name"],
            F.lit(" ("),
            F.coalesce(value_text(c["kind"], c["value"]), F.lit("missing")),
            F.lit("): "),
            text.signed(c["phi"], 3),
        )

    def sentences(name: str) -> Column:
        # A missing entry gives a NULL sentence, which concat_ws leaves out.
        return F.concat_ws("; ", *[sentence(F.get(F.col(name), F.lit(i))) for i in range(k)]).alias(f"{name}_text")

    return explain_rows(attributed, k).select(key, sentences("increasing"), sentences("decreasing"))


def waterfall(attributed: DataFrame, key: str = ID) -> DataFrame:
    """Steps from the base to the logit, largest contribution first, then the total."""
    entries = _entries(attributed)
    ordered = F.sort_array(
        F.array(
            *[
                F.struct((-F.abs(c["phi"])).alias("k"), c["position"].alias("i"), c["feature"].alias("feature"), c["phi"].alias("phi"))
                for c in entries
            ]
        )
    )
    sorted_rows = attributed.select(key, F.col("base").alias("_level_0"), ordered.alias("_sorted"))
    # One running level per step, each in terms of the one before.
    for i in range(len(entries)):
        level = F.col(f"_level_{i}") + F.col("_sorted")[i]["phi"]
        sorted_rows = sorted_rows.withColumn(f"_level_{i + 1}", level)
    steps = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.col("_sorted")[i]["feature"].alias("feature"),
            F.col("_sorted")[i]["phi"].alias("phi"),
            F.col(f"_level_{i}").alias("start"),
            F.col(f"_level_{i + 1}").alias("end"),
        )
        for i in range(len(entries))
    ]
    total = F.struct(
        F.lit(len(entries) + 1).alias("step"),
        F.lit("Prediction").alias("feature"),
        F.lit(0.0).alias("phi"),
        F.lit(0.0).alias("start"),
        F.col(f"_level_{len(entries)}").alias("end"),
    )
    return sorted_rows.select(key, F.inline(F.array(*steps, total)))


def force_data(attributed: DataFrame, key: str = ID) -> DataFrame:
    """Features from most risk-reducing to most risk-increasing, with label and sign."""
    ordered = F.sort_array(
        F.array(
            *[
                F.struct(c["phi"].alias("phi"), c["position"].alias("i"), c["feature"].alias("feature"))
                for c in _entries(attributed)
            ]
        )
    )
    phi = F.col("c.phi")
    return attributed.select(key, F.posexplode(ordered).alias("i", "c")).select(
        key,
        (F.col("i") + 1).alias("position"),
        "c.feature",
        phi.alias("phi"),
        text.signed(phi, 3).alias("label"),
        F.when(phi > 0, "increases").otherwise("decreases").alias("effect"),
    )


def beeswarm(
    df: DataFrame, model: LinearModel, background: DataFrame | None = None, key: str = ID
) -> DataFrame:
    """``(key, feature, phi, color, rank)`` for every row and feature.

    ``color`` is z scaled to 0..1 within the feature (0 for a constant one) and
    ``rank`` the feature's global importance. Both come from one aggregate of one
    row, which is joined before the rows are taken apart.
    """
    features, neutral = model.features, {}
    rows = df
    if background is not None:
        rows = df.crossJoin(F.broadcast(background_means(background, model)))
        neutral = {f: F.col(f"bg_{f}") for f in features}
    measured = [
        F.struct(
            F.min(model.z(f)).alias("lo"),
            F.max(model.z(f)).alias("hi"),
            (-F.avg(F.abs(model.contribution(f, neutral.get(f))))).alias("order"),
            F.lit(f).alias("feature"),
        )
        for f in features
    ]
    ends = rows.agg(F.array(*measured).alias("ends"))
    ordered = F.array_sort(F.transform("ends", lambda e: F.struct(e["order"], e["feature"])))
    ranked = ends.withColumn("ordered", F.transform(ordered, lambda e: e["feature"])).select(
        F.transform(
            "ends",
            lambda e: F.struct(
                e["lo"].alias("lo"),
                e["hi"].alias("hi"),
                F.array_position(F.col("ordered"), e["feature"]).cast("int").alias("rank"),
            ),
        ).alias("of")
    )
    color = F.coalesce(
        F.try_divide(F.col("c.z") - F.col("of.lo"), F.col("of.hi") - F.col("of.lo")), F.lit(0.0)
    )
    # The array is in the order of the features, as the contributions are.
    return (
        linear_attribution(df, model, background, key)
        .crossJoin(F.broadcast(ranked))
        .select(key, F.inline(F.arrays_zip(F.col("contributions").alias("c"), F.col("of"))))
        .select(key, "c.feature", "c.phi", color.alias("color"), "of.rank")
    )


def attribution_wide(attributed: DataFrame, features: Sequence[str], key: str = ID) -> DataFrame:
    """Wide form with one ``phi_<feature>`` column per feature."""
    return attributed.select(
        key, "base", *[F.col("contributions")[i]["phi"].alias(f"phi_{f}") for i, f in enumerate(features)]
    )
