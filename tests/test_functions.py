"""Row-wise expressions on literal edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from creditloom.functions import features, labels, text
from creditloom.functions.keys import shuffle_key
from creditloom.operators import scoring
from creditloom.operators.features import add_derived_features, clip_outliers, fix_sentinel, impute_nulls


def column(df, name):
    return [r[name] for r in df.orderBy("id").select(name).collect()]


@pytest.fixture(scope="module")
def applications(spark):
    schema = (
        "id long, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, DAYS_BIRTH int, "
        "DAYS_EMPLOYED int, EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double"
    )
    rows = [
        (1, 0.0, 100.0, 10.0, -9125, -365, 0.2, 0.4, 0.6),
        (2, -1.0, 100.0, None, -9124, 0, 0.2, None, 0.6),
        (3, 99.0, 500.0, 50.0, -20075, 365243, None, None, None),
        (4, 999.0, 500.0, 50.0, None, None, None, 0.5, None),
    ]
    return spark.createDataFrame(rows, schema)


def test_derived_features(applications):
    df = add_derived_features(applications)
    assert column(df, "AGE_YEARS") == [25.0, 9124 / 365, 55.0, None]
    assert column(df, "EMPLOYED_YEARS") == [1.0, 0.0, 0.0, 0.0]
    assert column(df, "DEBT_TO_INCOME") == [100.0, None, 5.0, 0.5]
    assert column(df, "ANNUITY_TO_INCOME") == [10.0, None, 0.5, 0.05]
    assert column(df, "EXT_SOURCE_AVG") == [pytest.approx(0.4), pytest.approx(0.4), None, 0.5]


def test_derived_features_need_their_inputs(applications):
    df = add_derived_features(applications.select("id", "DAYS_BIRTH", "EXT_SOURCE_2"))
    assert df.columns == ["id", "DAYS_BIRTH", "EXT_SOURCE_2", "AGE_YEARS", "EXT_SOURCE_AVG"]


def test_sentinel(applications):
    assert column(fix_sentinel(applications), "DAYS_EMPLOYED") == [-365, 0, 0, None]


def test_impute(applications):
    df = impute_nulls(applications, exclude=("id",))
    assert column(df, "EXT_SOURCE_1") == [0.2, 0.2, 0.2, 0.2]
    assert column(df, "EXT_SOURCE_2") == [0.4, 0.45, 0.45, 0.5]
    assert column(df, "AMT_ANNUITY") == [10.0, 0.0, 50.0, 50.0]
    assert column(df, "DAYS_BIRTH") == [-9125, -9124, -20075, 0]


def test_impute_leaves_the_outcome_alone(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, 3.0)], "SK_ID_CURR long, TARGET int, x double")
    rows = {r[0]: r for r in impute_nulls(df).collect()}
    assert rows[1]["TARGET"] is None and rows[1]["x"] == 0.0


def test_clip_keeps_null_and_constants(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(101)] + [(200, None, 5.0)], "id int, x double, c double")
    out = {r["id"]: r for r in clip_outliers(df, ["x", "c", "absent"]).collect()}
    assert out[200]["x"] is None
    assert out[0]["x"] == 1.0 and out[100]["x"] == 99.0 and out[50]["x"] == 50.0
    assert {r["c"] for r in out.values()} == {5.0}


@pytest.mark.parametrize(
    ("days", "group"),
    [(-24 * 365, "18-24"), (-25 * 365, "25-34"), (-35 * 365 + 1, "25-34"), (-45 * 365, "45-54"), (-55 * 365, "55+"), (None, "55+")],
)
def test_age_group(spark, days, group):
    df = spark.createDataFrame([(days,)], "DAYS_BIRTH int")
    assert df.select(labels.age_group()).first()[0] == group


@pytest.mark.parametrize(
    ("p", "band"),
    [(0.1499, "Low Risk"), (0.15, "Medium Risk"), (0.2999, "Medium Risk"), (0.30, "High Risk"), (1.2, "High Risk"), (None, None)],
)
def test_risk_band(spark, p, band):
    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(labels.risk_band(F.col("p"))).first()[0] == band


@pytest.mark.parametrize(("a", "level"), [(5.0, "Aligned"), (5.01, "Moderate"), (10.0, "Moderate"), (10.01, "Significant"), (None, None)])
def test_agreement(spark, a, level):
    df = spark.createDataFrame([(a,)], "d double")
    assert df.select(labels.agreement(F.col("d"))).first()[0] == level


def test_status_gender_gauge_flag(spark):
    df = spark.createDataFrame([(0, "M", 0.5), (1, "XNA", 1.5), (None, None, None), (2, "F", 1.0)], "TARGET int, CODE_GENDER string, p double")
    assert [r[0] for r in df.select(labels.status()).collect()] == ["Repaid", "Defaulted", None, None]
    assert [r[0] for r in df.where(labels.known_gender()).select("CODE_GENDER").collect()] == ["M", "F"]
    assert [r[0] for r in df.select(labels.gauge(F.col("p"))).collect()] == [0.5, 1.0, None, 1.0]
    flags = [r[0] for r in spark.sql("SELECT 8.0D AS r UNION ALL SELECT 8.01D").select(labels.threshold_flag(F.col("r"))).collect()]
    assert flags == ["Below 8% threshold", "Above 8% threshold"]


def test_formatting(spark):
    df = spark.createDataFrame([(0.125, 1234567.5, -12775.0)], "a double, b double, c double")
    row = df.select(
        text.fixed(F.col("a"), 2),
        text.money(F.col("b")),
        text.percent(F.col("a")),
        text.times(F.col("a")),
        text.years_of_days(F.col("c")),
        text.signed(F.col("a"), 3),
        text.signed(F.col("c"), 0),
    ).first()
    # The same digits Python's format gives: ties go to the even digit.
    assert list(row) == [f"{0.125:.2f}", f"${1234567.5:,.0f}", f"{0.125:.1%}", f"{0.125:.1f}x", "35.0 years", "+0.125", "-12775"]


def test_shuffle_key_is_a_bijection(spark):
    df = spark.range(0, 200_000).withColumn("k", shuffle_key("id"))
    row = df.agg(F.count_distinct("k"), F.min("k"), F.max("k")).first()
    assert row[0] == 200_000 and row[1] >= 0 and row[2] < 2**32


def test_risk_factors(spark):
    schema = (
        "SK_ID_CURR long, income double, loan_amount double, annuity double, age double, employed_years double, "
        "ext_source_1 double, ext_source_2 double, ext_source_3 double"
    )
    rows = [
        (1, 100.0, 510.0, 31.0, 24.0, 0.5, 0.1, 0.2, 0.3),
        (2, 100.0, 199.0, 30.0, 46.0, 5.5, 0.7, 0.7, None),
        (3, 100.0, 300.0, 10.0, 30.0, 3.0, 0.5, 0.5, 0.5),
        (4, 0.0, 300.0, 10.0, 25.0, 1.0, 0.3, 0.3, 0.3),
        (5, 100.0, 500.0, 30.0, 45.0, 5.0, 0.6, 0.6, 0.6),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["SK_ID_CURR"]: [(f["effect"], f["factor"]) for f in r["factors"]] for r in scoring.risk_factors(df).collect()}
    assert got[1] == [("[-]", "scores"), ("[-]", "debt"), ("[~]", "age"), ("[-]", "employment"), ("[-]", "annuity")]
    assert got[2] == [("+", "scores"), ("+", "debt"), ("+", "age"), ("+", "employment")]
    assert got[3] == got[4] == [("", "balanced")]
    texts = {r["text"] for r in scoring.risk_factors_long(df).collect()}
    assert "High debt-to-income ratio (5.1x) increases risk" in texts
    assert "High annuity-to-income ratio (31.0%) strains repayment capacity" in texts
    assert scoring.risk_factors_long(df).where("SK_ID_CURR = 3").count() == 1


def test_whole_years_truncate(spark):
    df = spark.createDataFrame([(-9124,), (-9125,)], "DAYS_BIRTH int")
    assert [r[0] for r in df.select(features.whole_age_years()).collect()] == [24, 25]
    assert not math.isnan(df.select(features.age_years()).first()[0])
