"""Building blocks of the comparison SQL."""

from __future__ import annotations

from checks.binding import as_ctes
from checks.constants import FIRST, SEGMENTS
from creditloom.fixed import CLUSTER_FEATURES, MODEL_FEATURES
from creditloom.functions.scoring import LinearModel

RATE = "round(100e0 * sum(TARGET) / count(*), 2)"
SCORE_SUM = "coalesce(EXT_SOURCE_1, 0e0) + coalesce(EXT_SOURCE_2, 0e0) + coalesce(EXT_SOURCE_3, 0e0)"
SCORE_COUNT = (
    "(CASE WHEN EXT_SOURCE_1 IS NULL THEN 0 ELSE 1 END + CASE WHEN EXT_SOURCE_2 IS NULL THEN 0 ELSE 1 END"
    " + CASE WHEN EXT_SOURCE_3 IS NULL THEN 0 ELSE 1 END)"
)
DERIVED = f"""DAYS_BIRTH / -365e0 AS AGE_YEARS,
  CASE WHEN DAYS_EMPLOYED < 0 THEN DAYS_EMPLOYED / -365e0 ELSE 0e0 END AS EMPLOYED_YEARS,
  AMT_CREDIT / (AMT_INCOME_TOTAL + 1e0) AS DEBT_TO_INCOME,
  AMT_ANNUITY / (AMT_INCOME_TOTAL + 1e0) AS ANNUITY_TO_INCOME,
  AMT_ANNUITY / (AMT_CREDIT + 1e0) AS CREDIT_UTIL,
  CASE WHEN {SCORE_COUNT} > 0 THEN ({SCORE_SUM}) / {SCORE_COUNT} END AS EXT_SOURCE_AVG"""
BORROWER = (
    "SK_ID_CURR, TARGET, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, DAYS_BIRTH, DAYS_EMPLOYED, "
    "EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3"
)
BAND = "CASE WHEN {0} < 0.15e0 THEN 'Low Risk' WHEN {0} < 0.3e0 THEN 'Medium Risk' ELSE 'High Risk' END"


def with_tables(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([as_ctes(), *ctes]) + "\n" + select


def cte(name: str, text: str) -> str:
    return f"{name} AS ({text})"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def shuffled(source: str, name: str = "keyed", where: str = "TRUE") -> str:
    """A CTE with the portable shuffle key of the borrower as column k."""
    mask, factor = 4294967295, 73244475
    first = f"SELECT *, xor(xor(SK_ID_CURR, SK_ID_CURR >> 32), 42) & {mask} AS k0 FROM {source} WHERE {where}"
    second = f"SELECT *, (xor(k0, k0 >> 16) * {factor}) & {mask} AS k1 FROM ({first})"
    third = f"SELECT *, (xor(k1, k1 >> 16) * {factor}) & {mask} AS k2 FROM ({second})"
    return cte(name, f"SELECT * EXCLUDE (k0, k1, k2), xor(k2, k2 >> 16) AS k FROM ({third})")


# Features of the default model for every labelled application.
MODEL_ROWS = cte(
    "model_rows",
    f"""SELECT * REPLACE (CASE WHEN DAYS_EMPLOYED > 0 THEN 0 ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED)
FROM (SELECT {BORROWER}, {DERIVED} FROM applications WHERE TARGET IS NOT NULL)""",
)


def z(feature: str, model: LinearModel) -> str:
    mean, std = model.moments[feature]
    return f"((coalesce(CAST({feature} AS DOUBLE), {model.medians[feature]!r}::DOUBLE) - ({mean!r}::DOUBLE)) / {std!r}::DOUBLE)"


def logit(model: LinearModel) -> str:
    return f"({model.intercept!r}::DOUBLE)" + "".join(
        f" + ({w!r}::DOUBLE) * {z(f, model)}" for f, w in model.weights.items()
    )


def probability(model: LinearModel) -> str:
    return f"1e0 / (1e0 + exp(-({logit(model)})))"


def phi(feature: str, model: LinearModel) -> str:
    return f"({model.weights[feature]!r}::DOUBLE) * {z(feature, model)}"


# One row per application and feature.
ATTRIBUTION = cte(
    "attribution",
    union(
        [
            f"SELECT SK_ID_CURR, {i} AS i, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {z(f, FIRST)} AS z, "
            f"{phi(f, FIRST)} AS phi FROM model_rows"
            for i, f in enumerate(MODEL_FEATURES)
        ]
    ),
)

# Segmentation input: derived, zero-filled, clipped at the 1st and 99th percentile.
PREPARED = (
    cte(
        "zeroed",
        f"""SELECT * REPLACE (coalesce(DEBT_TO_INCOME, 0e0) AS DEBT_TO_INCOME,
  coalesce(ANNUITY_TO_INCOME, 0e0) AS ANNUITY_TO_INCOME, coalesce(CREDIT_UTIL, 0e0) AS CREDIT_UTIL,
  coalesce(AMT_ANNUITY, 0e0) AS AMT_ANNUITY, coalesce(EXT_SOURCE_AVG, 0e0) AS EXT_SOURCE_AVG)
FROM (SELECT {BORROWER}, {DERIVED} FROM applications WHERE EXT_SOURCE_2 IS NOT NULL)""",
    ),
    cte(
        "bounds",
        """SELECT quantile_cont(DEBT_TO_INCOME, 0.01) AS dlo, quantile_cont(DEBT_TO_INCOME, 0.99) AS dhi,
  quantile_cont(ANNUITY_TO_INCOME, 0.01) AS alo, quantile_cont(ANNUITY_TO_INCOME, 0.99) AS ahi,
  median(EXT_SOURCE_1) AS m1, median(EXT_SOURCE_2) AS m2, median(EXT_SOURCE_3) AS m3 FROM zeroed""",
    ),
    cte(
        "prepared",
        """SELECT zeroed.* REPLACE (least(greatest(DEBT_TO_INCOME, dlo), dhi) AS DEBT_TO_INCOME,
  least(greatest(ANNUITY_TO_INCOME, alo), ahi) AS ANNUITY_TO_INCOME,
  coalesce(EXT_SOURCE_1, m1) AS EXT_SOURCE_1, coalesce(EXT_SOURCE_2, m2) AS EXT_SOURCE_2,
  coalesce(EXT_SOURCE_3, m3) AS EXT_SOURCE_3) FROM zeroed, bounds""",
    ),
)


def _distance(centre) -> str:
    terms = []
    for f, v in zip(CLUSTER_FEATURES, centre, strict=True):
        mean, std = SEGMENTS.moments[f]
        terms.append(f"pow(({f} - {mean!r}::DOUBLE) / {std!r}::DOUBLE - ({v!r}::DOUBLE), 2)")
    return " + ".join(terms)


TIERS = (
    *PREPARED,
    cte(
        "clustered",
        f"""SELECT * EXCLUDE (d0, d1, d2),
  CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster
FROM (SELECT *, {', '.join(f'{_distance(c)} AS d{i}' for i, c in enumerate(SEGMENTS.centres))} FROM prepared)""",
    ),
    cte(
        "ranked",
        """SELECT cluster, avg(EXT_SOURCE_AVG) AS mean_score,
  row_number() OVER (ORDER BY avg(EXT_SOURCE_AVG) DESC, cluster) AS r FROM clustered GROUP BY cluster""",
    ),
    cte(
        "tiers",
        """SELECT clustered.*, CASE r WHEN 1 THEN 'Low Risk' WHEN 2 THEN 'Medium Risk' ELSE 'High Risk' END AS RISK_TIER
FROM clustered JOIN ranked USING (cluster)""",
    ),
)
