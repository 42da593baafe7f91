"""Portfolio, distribution, correlation and segmentation operators on literal frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.operators import distributions, drivers, frames, portfolio, segmentation
from creditloom.operators.features import prepare_clustering_data, prepare_model_features


@pytest.fixture(scope="module")
def segments(spark):
    rows = [("small", 1)] * 100 + [("big", 1)] * 10 + [("big", 0)] * 91 + [("tie", 1)] * 10 + [("tie", 0)] * 91
    rows += [("XNA", 0)] * 150 + [(None, 1)] * 2 + [("open", None)] * 101
    return spark.createDataFrame(rows, "k string, TARGET int").withColumn("AMT_INCOME_TOTAL", F.lit(10.0))


def test_top_segments(segments):
    got = [tuple(r) for r in portfolio.top_segments(segments, "k").collect()]
    assert got == [("big", 101, 10.0, 9.9), ("tie", 101, 10.0, 9.9), ("XNA", 150, 10.0, 0.0), ("open", 101, 10.0, None)]
    assert [r[0] for r in portfolio.top_segments(segments, "k", k=1).collect()] == ["big"]


def test_unknown_outcomes_stay_in_the_denominator(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (None,)], "TARGET int")
    assert portfolio.portfolio_default_rate(df).first().asDict() == {
        "total_borrowers": 4,
        "total_defaults": 1,
        "default_rate_pct": 25.0,
    }


def test_share_and_balance(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 0)], "NAME_CONTRACT_TYPE string, TARGET int")
    assert {r[0]: r["share_pct"] for r in portfolio.share_of_total(df).collect()} == {"a": 75.0, "b": 25.0}
    assert portfolio.class_balance(df).first().asDict() == {"repaid": 3, "defaulted": 1, "default_rate": 0.25, "scale_pos_weight": 3.0}


def test_overview_equals_single_queries(tables):
    whole = {(r["dimension"], r["segment"]): r for r in portfolio.overview(tables.applications).collect()}
    for r in portfolio.default_rate_by_contract_type(tables.applications).collect():
        assert whole[("NAME_CONTRACT_TYPE", r[0])]["default_rate_pct"] == r["default_rate"]
    assert whole[("all", "all")]["total_borrowers"] == tables.applications.count()


def test_joins_with_one_hot_borrower(spark):
    """A third of all child rows belong to one borrower."""
    apps = spark.createDataFrame(
        [(i, i % 2, 100.0 * i, "F" if i < 4 else "M") for i in range(8)] + [(9, 0, 1.0, "XNA")],
        "SK_ID_CURR long, TARGET int, AMT_INCOME_TOTAL double, CODE_GENDER string",
    )
    child = spark.range(3000).select(
        F.when(F.col("id") < 1000, 1).otherwise(F.col("id") % 7).cast("long").alias("SK_ID_CURR"),
        F.col("id").alias("SK_ID_BUREAU"),
        F.when(F.col("id") % 3 == 0, "Refused").otherwise("Approved").alias("NAME_CONTRACT_STATUS"),
    )
    joined = apps.join(child, "SK_ID_CURR").collect()
    for r in portfolio.previous_status_analysis(apps, child).collect():
        part = [j for j in joined if j["NAME_CONTRACT_STATUS"] == r["NAME_CONTRACT_STATUS"]]
        assert r["count"] == len(part)
        assert r["avg_income"] == round(sum(j["AMT_INCOME_TOTAL"] for j in part) / len(part))
        assert r["default_rate_pct"] == pytest.approx(100 * sum(j["TARGET"] for j in part) / len(part), abs=0.005001)
    counts = {r["SK_ID_CURR"]: r["bureau_count"] for r in portfolio.bureau_count_per_borrower(apps, child).collect()}
    assert counts[7] == 0 and counts[9] == 0 and sum(counts.values()) == 3000
    by_gender = {r["CODE_GENDER"]: r for r in portfolio.bureau_loans_by_gender(apps, child).collect()}
    assert set(by_gender) == {"F", "M"}
    assert by_gender["M"]["borrowers"] == 4
    assert by_gender["M"]["avg_bureau_loans"] == pytest.approx(sum(counts[i] for i in (4, 5, 6)) / 3, abs=0.05)


def test_feature_whitelist(tables):
    with pytest.raises(ValueError, match="not allowed"):
        frames.feature_by_target(tables.applications, "SK_ID_CURR; DROP TABLE x")


def test_histogram_covers_every_row(spark):
    df = spark.range(1000).select(F.sqrt("id").alias("x"), (F.col("id") % 3).alias("g"))
    rows = distributions.histogram(df, "x", "g", bins=7).collect()
    assert sum(r["count"] for r in rows) == 1000
    assert {r["bin"] for r in rows} == set(range(7))
    assert max(r["bin_end"] for r in rows) == pytest.approx(np.sqrt(999))
    constant = distributions.histogram(df.select(F.lit(3.0).alias("x")), "x").collect()
    assert [(r["bin"], r["count"]) for r in constant] == [(0, 1000)]


def test_density_integrates_to_one(spark):
    df = spark.range(1000).select(F.sqrt("id").alias("x"), (F.col("id") % 3).alias("g"))
    rows = distributions.density_histogram(df, "x", "g").collect()
    for g in range(3):
        assert sum(r["density"] * (r["bin_end"] - r["bin_start"]) for r in rows if r["g"] == g) == pytest.approx(1.0)


def test_box_stats(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 100, -100]] + [("b", 5.0), ("c", None), ("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in distributions.box_stats(df, "x", "g", ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["whisker_low"], got["a"]["whisker_high"], got["a"]["outliers"], got["a"]["median"]) == (1.0, 4.0, 2, 2.5)
    assert (got["b"]["q1"], got["b"]["q3"], got["b"]["outliers"], got["b"]["n"]) == (5.0, 5.0, 0, 1)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 2.0)], "i int, s string, x double")
    got = {r["column"]: r for r in distributions.profile(df).collect()}
    assert set(got) == {"i", "x"}
    assert got["x"]["count"] == 2 and got["x"]["p50"] == 1.5 and got["i"]["std"] == 1.0
    assert distributions.profile(df.limit(1)).count() == 0
    assert distributions.profile(df.select("s")).count() == 0


def test_correlation_edge_cases(spark):
    rows = [(i % 2, float(i), -2.0 * i, 7.0, float(i) if i < 50 else None, None if i < 50 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "TARGET int, a double, b double, c double, d double, e double")
    ranked = drivers.target_correlation(df).collect()
    assert "c" not in [r["feature"] for r in ranked]
    by_name = {r["feature"]: r for r in ranked}
    assert by_name["a"]["direction"] == "Increases Default" and by_name["b"]["direction"] == "Decreases Default"
    m = {(r["a"], r["b"]): r["r"] for r in drivers.correlation_matrix(df, ["a", "b", "c", "d", "e"]).collect()}
    assert m[("a", "b")] == pytest.approx(-1.0) and m[("b", "a")] == m[("a", "b")]
    assert m[("a", "a")] == 1.0 and m[("c", "c")] is None and m[("a", "c")] is None
    assert ("d", "e") not in m or m[("d", "e")] is None
    x = np.array([r[1] for r in rows][:50])
    y = np.array([r[0] for r in rows][:50])
    assert by_name["d"]["correlation"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    wide = drivers.pivot_matrix(drivers.correlation_matrix(df, ["b", "a"]), ["b", "a"]).collect()
    assert [r[0] for r in wide] == ["b", "a"]


def test_sentinel_option_changes_the_correlation(tables):
    frame = frames.driver_frame(tables.applications)
    with_sentinel = {r["feature"]: r["correlation"] for r in drivers.target_correlation(frame, k=18).collect()}
    fixed = {r["feature"]: r["correlation"] for r in drivers.target_correlation(frame, k=18, sentinel_fixed=True).collect()}
    assert with_sentinel["DAYS_EMPLOYED"] != fixed["DAYS_EMPLOYED"]


def test_clusters_beyond_the_third_stay_high(spark):
    df = spark.createDataFrame([(c, s) for c, s in ((0, 0.1), (1, 0.9), (2, 0.5), (3, 0.3))], "cluster int, EXT_SOURCE_AVG double")
    out, mapping = segmentation.map_clusters_to_risk(df)
    assert mapping == {1: "Low Risk", 2: "Medium Risk", 3: "High Risk", 0: "High Risk"}
    assert {r["cluster"]: r["RISK_TIER"] for r in out.collect()} == mapping


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(3)
    centres = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = [(int(i), *(float(v) for v in rng.normal(c, 0.3))) for i, c in enumerate(centres) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    fitted = segmentation.fit_kmeans(df, ["a", "b"], restarts=3)
    pairs = segmentation.assign_clusters(df, fitted).select("g", "cluster").distinct().collect()
    assert len(pairs) == 3 and len({p["cluster"] for p in pairs}) == 3
    single = segmentation.fit_kmeans(df, ["a", "b"], restarts=1)
    assert fitted.cost <= single.cost + 1e-9


def test_kmeans_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, a double, b double")
    found = [segmentation.fit_kmeans(df.repartition(n), ["a", "b"], restarts=1) for n in (1, 4, 16)]
    for fit in found[1:]:
        assert np.allclose(fit.centres, found[0].centres) and fit.cost == pytest.approx(found[0].cost)


def test_prepared_frames(tables):
    prepared, names = prepare_clustering_data(frames.clustering_frame(tables.applications))
    assert names == list(X.CLUSTER_FEATURES)
    assert prepared.where(" OR ".join(f"{c} IS NULL" for c in names)).count() == 0
    raw, names = prepare_model_features(frames.training_frame(tables.applications), impute=False)
    assert names == list(X.MODEL_FEATURES)
    assert raw.where("AMT_ANNUITY IS NULL").count() > 0
    assert raw.where("DAYS_EMPLOYED > 0").count() == 0


def test_starting_centres_are_drawn_without_sorting(spark, monkeypatch):
    """A grouped minimum of structs sorts every row of every restart."""
    df = spark.createDataFrame([(i, float(i % 7), float(i % 11)) for i in range(300)], "id long, a double, b double")
    plans, collect = [], type(df).collect

    def noted(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(df), "collect", noted)
    vectors = df.select(F.col("id").alias("_name"), F.col("a").alias("z_a"), F.col("b").alias("z_b"))
    centres = segmentation._seeds(vectors, ["a", "b"], 3, 1, 4)
    assert len(plans) == 9 and not any("SortAggregate" in p for p in plans)
    points = {(float(i % 7), float(i % 11)) for i in range(300)}
    assert len(centres) == 4 and all(len({tuple(c) for c in some} & points) == 3 for some in centres)
