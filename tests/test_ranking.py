"""Quantiles, selections and running totals against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.functions.keys import shuffle_key
from creditloom.operators import ranking, sampling

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def frame(spark, values, partitions=3):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(partitions)


def check(spark, values):
    got = ranking.quantile_values(frame(spark, values), {"x": PROBS})["x"]
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300), p


@pytest.mark.parametrize("cells", [4.0, 65536.0])
def test_quantiles_of_awkward_values(spark, monkeypatch, cells):
    """With few cells the intervals are cut again and again until they are points."""
    monkeypatch.setattr(ranking, "FINE_CELLS", cells)
    rng = np.random.default_rng(1)
    check(spark, [7.0])
    check(spark, [0.0, -0.0, 1e300, -1e300, 5e-324, 1.0])
    # A third of all rows share one value, the rest crowd into one coarse cell.
    check(spark, np.concatenate([np.full(300, 0.5), 1 + rng.random(600) * 1e-6]))


def test_quantiles_by_group_and_missing_values(spark):
    rows = [("a", float(i), None) for i in range(10)] + [("b", None, None), ("b", float("nan"), None), ("c", 3.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r["g"], r["p"]): r["value"] for r in ranking.quantiles(df, {"x": (0.25, 0.5), "y": (0.5,)}, "g", ["a", "b"]).collect()}
    assert got == {("a", 0.25): 2.25, ("a", 0.5): 4.5}
    assert ranking.quantile_values(df, {"y": (0.5,)}) == {"y": {0.5: None}}
    with pytest.raises(ValueError):
        ranking.quantiles(df, {"x": (0.5,)}, by="g")


def test_sketched_quantiles_are_close(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    got = ranking.quantile_values(df, {"x": (0.1, 0.9)}, accuracy=1000)["x"]
    assert abs(got[0.1] - 1000) <= 20 and abs(got[0.9] - 9000) <= 20


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=40))
def test_quantiles_of_any_values(spark, values):
    got = ranking.quantile_values(frame(spark, values, 2), {"x": (0.3,)})["x"][0.3]
    low, high = min(values), max(values)
    assert got == pytest.approx(np.quantile(values, 0.3), rel=1e-9, abs=1e-9 * max(abs(low), abs(high), 1))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_selection_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(5000).withColumn("g", (F.col("id") % 3 == 0).cast("int")).repartition(partitions)
    got = sorted(r["id"] for r in sampling.stratified_sample(df, {0: 100, 1: 50}, "g", "id").collect())
    rows = df.withColumn("k", shuffle_key("id")).collect()
    want = []
    for g, n in ((0, 100), (1, 50)):
        want += [r["id"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: (r["k"], r["id"]))[:n]]
    assert got == sorted(want)


def test_selection_with_one_crowded_cell(spark):
    """A third of the rows carry the same identifier, hence the same key."""
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("id"))
    for n in (0, 1, 500, 1500, 3000, 9999):
        assert sampling.deterministic_cap(df, n, "id").count() == min(n, 3000)
    assert sampling.deterministic_cap(df, None, "id") is df


def awkward(spark):
    """1,000 rows: a missing identifier in 100, one identifier in 300, 200 whole copies, the rest unique."""
    x = F.when(F.col("i") < 400, F.col("i") % 97).when(F.col("i") < 600, F.lit(5)).otherwise(F.col("i"))
    identifier = (
        F.when(F.col("i") < 100, None)
        .when(F.col("i") < 400, 7)
        .when(F.col("i") < 600, 8)
        .when(F.col("i") % 50 == 0, F.col("i") + (1 << 40))
        .when(F.col("i") % 50 == 1, -F.col("i"))
        .otherwise(F.col("i"))
    )
    df = spark.range(1000).withColumnRenamed("id", "i")
    return df.select(identifier.cast("long").alias("id"), x.alias("x"), (F.col("i") % 2).cast("int").alias("g"))


@pytest.mark.parametrize("n", [0, 1, 50, 99, 100, 101, 399, 500, 777, 999, 1000, 2000])
def test_selection_is_total(spark, n):
    """Exact quotas with missing and repeated identifiers, the same rows for any partitioning."""
    df = awkward(spark)
    found = {
        parts: sorted(map(str, sampling.deterministic_cap(df.repartition(parts), n, "id").collect()))
        for parts in (1, 4, 16)
    }
    assert len(found[1]) == min(n, 1000) and found[1] == found[4] == found[16]
    rows = sorted(
        ((-1 if r["id"] is None else r["k"], r["id"] is not None, r["id"] or 0) for r in df.withColumn("k", shuffle_key("id")).collect())
    )[:n]
    ids = sorted(str(i if known else None) for _, known, i in rows)
    assert ids == sorted(str(r["id"]) for r in sampling.deterministic_cap(df, n, "id").collect())


def test_strata_with_missing_identifiers(spark):
    df = awkward(spark)
    counts = {
        (r["g"], r["is_test"]): r["count"]
        for r in sampling.stratified_split(df, "g", key="id").groupBy("g", "is_test").count().collect()
    }
    assert counts == {(g, t): n for g in (0, 1) for t, n in ((True, 100), (False, 400))}
    assert sampling.stratified_sample(df, {0: 300, 1: 299}, "g", "id").count() == 599


def test_large_groups_of_copies_are_counted(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DIGIT_BITS", 4)
    df = spark.range(500).select(F.lit(3).cast("long").alias("id"), F.lit("same").alias("x"))
    for n in (1, 16, 17, 250, 499):
        marked = ranking.mark_first(df, shuffle_key("id"), "id", lambda _, rows, n=n: n)
        assert marked.count() == 500 and marked.where("selected").count() == n


def test_sample_larger_than_a_class_fails(spark):
    df = spark.range(10).withColumn("TARGET", (F.col("id") < 2).cast("int"))
    with pytest.raises(ValueError, match="TARGET=1"):
        sampling.stratified_sample(df, {0: 5, 1: 3}, key="id")
    with pytest.raises(ValueError, match="TARGET=2"):
        sampling.stratified_sample(df, {2: 1}, key="id")


def test_split_is_stratified(spark):
    df = spark.range(1035).withColumn("TARGET", (F.col("id") < 35).cast("int"))
    counts = {(r["TARGET"], r["is_test"]): r["count"] for r in sampling.stratified_split(df, key="id").groupBy("TARGET", "is_test").count().collect()}
    assert counts == {(0, True): 200, (0, False): 800, (1, True): 7, (1, False): 28}


def test_proportional_sizes_and_children(spark):
    df = spark.range(100).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") < 20).cast("int").alias("TARGET"))
    assert sampling.proportional_sizes(df, 50) == {0: 40, 1: 10}
    sampled = sampling.stratified_sample(df, {0: 8, 1: 2})
    child = spark.range(1000).select((F.col("id") % 100).alias("SK_ID_CURR"))
    kept = sampling.subset_children(child, sampled)
    assert kept.count() == 100
    assert kept.join(sampled, "SK_ID_CURR", "left_anti").count() == 0


@pytest.mark.parametrize("rows", [1, 3, 4096])
def test_running_totals_of_awkward_orders(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "SLICE_ROWS", rows)
    values = [float("-inf"), -1e300, -2.0, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(x, 1) for x in [None, *values]], "x double, n int").repartition(4)
    got = {str(r["x"]): r["n_upto"] for r in ranking.running_totals(df, "x", ["n"]).collect()}
    assert got == {str(x): i + 1 for i, x in enumerate([None, *values])}
    assert ranking.running_totals(df.limit(0), "x", ["n"]).count() == 0


def test_scores_are_read_once(spark, tmp_path):
    """The input is scanned by the job that writes the counts, and not again."""
    from creditloom.operators import evaluation

    df = spark.createDataFrame([(1, 0.3), (0, 0.2), (1, 0.2)], "TARGET int, p double")
    df.write.parquet(str(tmp_path / "scored"))
    auc = evaluation.roc_auc(spark.read.parquet(str(tmp_path / "scored")))
    plan = auc._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "score-counts" in plan
    assert auc.first()["auc"] == 0.75


@pytest.mark.parametrize("rows", [7, 100, 1 << 14])
def test_running_totals_of_unlike_groups(spark, monkeypatch, rows):
    """One group's values lie within a millionth of the other's range: each has slices of its own."""
    monkeypatch.setattr(ranking, "SLICE_ROWS", rows)
    x = F.when(F.col("id") % 2 == 0, F.col("id") * 1.0).otherwise(0.5 + F.col("id") / 1e9)
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), x.alias("x"), (F.col("id") % 7).alias("n")).repartition(6)
    got = sorted(ranking.running_totals(df, "x", ["n"], ["g"]).collect(), key=lambda r: (r["g"], r["x"]))
    for g in (0, 1):
        part = [r for r in got if r["g"] == g]
        assert [r["n_upto"] for r in part] == list(np.cumsum([r["n"] for r in part]))


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.sqrt("id").alias("x"), F.lit(1).alias("n"), F.col("id").alias("m"))
    got = ranking.running_totals(df.repartition(5), "x", ["n", "m"], ["g"]).collect()
    rows = sorted(got, key=lambda r: (r["g"], r["x"]))
    for g in (0, 1):
        part = [r for r in rows if r["g"] == g]
        assert [r["n_upto"] for r in part] == list(range(1, 251))
        assert [r["m_upto"] for r in part] == list(np.cumsum([r["m"] for r in part]))
