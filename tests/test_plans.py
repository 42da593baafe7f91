"""Physical plans: pruned scans, pushed filters, bounded broadcasts, no Python."""

import re

import pytest

from checks import QUERIES

# The result of these is computed before they return, or needs a fit.
EAGER = {"kmeans_segment", "train_and_compare", "importance_comparison", "logistic_fit", "csv_ingest", "stored_metrics", "load_manifest", "source_resolution", "latin1_csv", "model_round_trip"}
NAMES = sorted(set(QUERIES) - EAGER)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_and_no_nested_loop_over_data(spark, small_dir, name):
    plan = plan_of(QUERIES[name](spark, small_dir))
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"):
        assert word not in plan, plan
    # Only one-row aggregates are cross joined, always as the broadcast side.
    for line in plan.splitlines():
        if "BroadcastNestedLoopJoin" in line:
            assert re.search(r"Cross|Inner", line), line


def test_scan_is_pruned_and_filtered(spark, tmp_path, tables):
    from creditloom.operators import portfolio

    tables.applications.write.parquet(str(tmp_path / "applications"))
    stored = spark.read.parquet(str(tmp_path / "applications"))
    plan = plan_of(portfolio.default_rate_by_gender(stored))
    assert "ReadSchema: struct<TARGET:int,CODE_GENDER:string>" in plan
    assert "Not(EqualTo(CODE_GENDER,XNA))" in plan
    from creditloom.operators.frames import capped_values

    assert "LessThanOrEqual(AMT_CREDIT,2000000" in plan_of(capped_values(stored, "AMT_CREDIT", 2_000_000))


def test_child_counts_shrink_before_the_shuffle(spark, tmp_path, tables):
    from creditloom.operators import portfolio

    plan = plan_of(portfolio.previous_status_analysis(tables.applications, tables.previous_application))
    # Bottom-up: a partial count sits below the exchange of the child rows.
    partial = plan.rindex("partial_count")
    assert "Exchange" in plan[:partial]


def test_explanations_need_no_shuffle(spark, tables):
    from checks.constants import FIRST
    from creditloom.operators import explain, frames
    from creditloom.operators.features import prepare_model_features

    rows = prepare_model_features(frames.training_frame(spark.createDataFrame([], tables.applications.schema)), impute=False)[0]
    attributed = explain.linear_attribution(rows, FIRST)
    for df in (explain.top_factors(attributed), explain.waterfall(attributed), explain.explanation_text(attributed), explain.force_data(attributed)):
        assert "Exchange" not in plan_of(df)
