"""Borrower segmentation into risk tiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.fixed import CLUSTER_RESTARTS, CLUSTERS, ID, RISK_TIERS, SEED, TARGET
from creditloom.functions import text
from creditloom.functions.labels import tier_rank
from creditloom.operators.features import collect_moments, prepare_clustering_data, scale
from creditloom.operators.frames import clustering_frame
from creditloom.session import materialise


@dataclass(frozen=True)
class Segmentation:
    """A fitted segmentation: scaling moments and centres in scaled units."""

    features: Sequence[str]
    moments: Mapping[str, tuple[float, float]]
    centres: Sequence[Sequence[float]]
    cost: float


def _distance(point: Callable[[str], Column], centre: Callable[[str], Column], features: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for f in features:
        total = total + F.pow(point(f) - centre(f), F.lit(2.0))
    return total


def _with_centres(vectors: DataFrame, features: Sequence[str], centres: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """Every row once for each restart, with ``_nearest`` (distance, cluster) among that restart's centres.

    The centres come as one broadcast row a restart, so that every round runs the same compiled plan.
    """
    k = len(centres[0])
    names = [f"_c{j}_{i}" for j in range(k) for i in range(len(features))]
    rows = [(r, *[float(v) for c in some for v in c]) for r, some in enumerate(centres)]
    schema = ", ".join(["_restart int", *[f"{n} double" for n in names]])
    table = vectors.sparkSession.createDataFrame(rows, schema)
    joined = vectors.crossJoin(F.broadcast(table))
    options = [
        F.struct(
            _distance(lambda f: F.col(f"z_{f}"), lambda f, j=j: F.col(f"_c{j}_{features.index(f)}"), features).alias("d"),
            F.lit(j).alias("cluster"),
        )
        for j in range(k)
    ]
    return joined.withColumn("_nearest", F.least(*options) if k > 1 else options[0]).drop(*names)


def _draw(named: Column, seed: int, step: int) -> Column:
    """A uniform number in (0, 1) for a row and restart; it depends on the row's name alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed) + F.col("_restart"), F.lit(step), named), 11)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def _seeds(vectors: DataFrame, features: Sequence[str], k: int, seed: int, restarts: int) -> list[list[list[float]]]:
    """Starting centres of every restart: rows drawn by the square of their distance to those drawn before.

    The row with the smallest ``-ln(u) / weight`` is such a draw, and a minimum
    doesn't depend on how the rows are dealt out. Passes draw for all restarts:
    they find the smallest lot, then the smallest name with that lot, then its
    point. Each keeps plain numbers only, which are aggregated by hash; a
    minimum of structs would sort every row of every restart.
    """
    spark = vectors.sparkSession
    centres: list[list[list[float]]] = [[] for _ in range(restarts)]
    for step in range(k):
        if step == 0:
            rows = vectors.crossJoin(F.broadcast(spark.range(restarts).select(F.col("id").cast("int").alias("_restart"))))
            weight = F.lit(1.0)
        else:
            rows = _with_centres(vectors, features, centres)
            weight = F.col("_nearest.d")
        lots = rows.withColumn(
            "_lot", F.coalesce(F.try_divide(-F.ln(_draw(F.col("_name"), seed, step)), weight), F.lit(float("inf")))
        )
        least = lots.groupBy("_restart").agg(F.min("_lot").alias("_least")).collect()
        wanted = spark.createDataFrame(least, "_restart int, _least double") if least else None
        if wanted is None:
            break
        first = lots.join(F.broadcast(wanted), "_restart").where(F.col("_lot") == F.col("_least"))
        names = first.groupBy("_restart").agg(F.min("_name").alias("_name")).collect()
        chosen = spark.createDataFrame(names, "_restart int, _name long")
        points = vectors.join(F.broadcast(chosen), "_name").groupBy("_restart").agg(*[F.min(f"z_{f}").alias(f) for f in features])
        for r in points.collect():
            centres[r["_restart"]].append([r[f] for f in features])
    return centres


def fit_kmeans(
    df: DataFrame,
    features: Sequence[str],
    k: int = CLUSTERS,
    seed: int = SEED,
    restarts: int = CLUSTER_RESTARTS,
    max_iter: int = 300,
    key: str = ID,
    tol: float = 1e-4,
) -> Segmentation:
    """K-Means on standardised features, the cheapest of ``restarts`` starts.

    All restarts share every pass over the data: a round is one scan with one
    grouped aggregation by restart and cluster, and a restart whose centres move
    no more than ``tol`` stands still. Starting rows are drawn by a hash of
    ``key`` (of the features, where there is none), so the fit depends neither on
    partitions nor on how rows arrive; as many tasks work as the data has
    partitions. Rows with a missing feature take no part. Only the scaled
    vectors are kept, on disk if need be; lost ones are recomputed.
    """
    moments = collect_moments(df, features)
    named = F.xxhash64(*([key] if key in df.columns else []), *features).alias("_name")
    scaled = scale(df.select(named, *features), moments).select("_name", *[f"z_{f}" for f in features])
    vectors = scaled.dropna().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres = _seeds(vectors, features, k, seed, restarts)
        if not centres[0]:
            raise ValueError("segmentation needs rows without missing features")
        moving = set(range(restarts))
        for _ in range(max_iter):
            some = sorted(moving)
            near = _with_centres(vectors, features, [centres[r] for r in some])
            means = [F.avg(f"z_{f}").alias(f) for f in features]
            moved = dict.fromkeys(some, 0.0)
            for r in near.groupBy("_restart", F.col("_nearest.cluster").alias("cluster")).agg(*means).collect():
                restart = some[r["_restart"]]
                old, new = centres[restart][r["cluster"]], [r[f] for f in features]
                moved[restart] = max(moved[restart], sum((a - b) ** 2 for a, b in zip(old, new, strict=True)))
                centres[restart][r["cluster"]] = new
            moving = {r for r in some if moved[r] > tol**2}
            if not moving:
                break
        near = _with_centres(vectors, features, centres)
        costs = dict(near.groupBy("_restart").agg(F.sum("_nearest.d")).collect())
    finally:
        vectors.unpersist()
    best = min(range(restarts), key=lambda r: (costs[r], r))
    return Segmentation(list(features), moments, centres[best], costs[best])


def nearest_centre(features: Sequence[str], centres: Sequence[Sequence[float]], prefix: str = "z_") -> Column:
    """Index of the nearest centre; the lowest index wins a tie.

    Every feature occurs once per centre, so that a filter on the result, pushed
    down by the optimizer, stays a short expression.
    """

    def distance(centre: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for f, v in zip(features, centre, strict=True):
            total = total + F.pow(F.col(f"{prefix}{f}") - F.lit(float(v)), F.lit(2.0))
        return total

    options = [F.struct(distance(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
    return (F.least(*options) if len(options) > 1 else options[0])["cluster"]


def assign_clusters(df: DataFrame, fitted: Segmentation) -> DataFrame:
    """Add ``cluster`` by nearest centre: an expression over the row alone."""
    return (
        scale(df, fitted.moments)
        .withColumn("cluster", nearest_centre(fitted.features, fitted.centres))
        .select(*df.columns, "cluster")
    )


def cluster_tiers(df: DataFrame, cluster: str = "cluster", score: str = "EXT_SOURCE_AVG") -> dict[int, str]:
    """The tier of each cluster: the higher its mean score, the lower its risk.

    Ranks beyond the third stay High. One row per cluster reaches the driver.
    """
    means = df.groupBy(cluster).agg(F.avg(score).alias("mean_score")).where(F.col(cluster).isNotNull())
    ranked = means.orderBy(F.desc("mean_score"), cluster).collect()
    return {r[cluster]: RISK_TIERS[min(i, len(RISK_TIERS) - 1)] for i, r in enumerate(ranked)}


def map_clusters_to_risk(
    df: DataFrame, cluster: str = "cluster", score: str = "EXT_SOURCE_AVG"
) -> tuple[DataFrame, dict[int, str]]:
    """Add ``RISK_TIER`` by the ranking of the clusters; also returns the mapping."""
    tiers = cluster_tiers(df, cluster, score)
    names = F.create_map(*[F.lit(part) for pair in tiers.items() for part in pair]).cast("map<int,string>")
    return df.withColumn("RISK_TIER", F.try_element_at(names, F.col(cluster).cast("int"))), tiers


def segment(
    applications: DataFrame, fitted: Segmentation | None = None, stored: bool = False
) -> tuple[DataFrame, Segmentation]:
    """The whole flow: prepare, fit unless given, assign, name the tiers.

    ``stored`` writes the result to the shared folder first. Choose it when
    several reports read the tiers, or filter on them.
    """
    prepared, features = prepare_clustering_data(clustering_frame(applications))
    fitted = fitted or fit_kmeans(prepared, features)
    tiers, _ = map_clusters_to_risk(assign_clusters(prepared, fitted))
    return (materialise(tiers, "tiers") if stored else tiers), fitted


def tier_summary(df: DataFrame) -> DataFrame:
    """Counts and rounded means per tier, in tier order."""
    return (
        df.groupBy("RISK_TIER")
        .agg(
            F.count(ID).alias("count"),
            F.round(F.avg(TARGET) * 100.0, 2).alias("default_rate_pct"),
            F.round(F.avg("EXT_SOURCE_AVG"), 3).alias("avg_score"),
            F.round(F.avg("DEBT_TO_INCOME"), 2).alias("avg_debt_to_income"),
            F.round(F.avg("AGE_YEARS"), 1).alias("avg_age"),
            F.round(F.avg("AMT_INCOME_TOTAL"), 0).alias("avg_income"),
        )
        .orderBy(tier_rank(F.col("RISK_TIER")))
    )


def tier_summary_text(df: DataFrame) -> DataFrame:
    """The summary with rates and incomes as text."""
    return tier_summary(df).withColumns(
        {
            "default_rate_pct": F.concat(text.fixed(F.col("default_rate_pct"), 2), F.lit("%")),
            "avg_income": text.money(F.col("avg_income")),
        }
    )


def default_rate_by_tier(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("RISK_TIER")
        .agg((F.avg(TARGET) * 100.0).alias("default_rate_pct"))
        .orderBy(tier_rank(F.col("RISK_TIER")))
    )
