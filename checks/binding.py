"""The three loan tables as views over the star-schema test tables.

One text per table serves both engines. All fractional literals are doubles:
a plain decimal literal means different types in the two.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

APPLICATIONS = """
SELECT k AS SK_ID_CURR,
  CAST(CASE WHEN h4 < CASE WHEN h2 < 300 THEN 180 WHEN h2 < 650 THEN 70 ELSE 20 END THEN 1 ELSE 0 END AS INT) AS TARGET,
  (bal + 1500) * CAST(90 AS DOUBLE) AS AMT_INCOME_TOTAL,
  tp * CAST(4.2 AS DOUBLE) AS AMT_CREDIT,
  CASE WHEN k % 97 = 0 THEN NULL ELSE tp / CAST(20 AS DOUBLE) END AS AMT_ANNUITY,
  CAST(-(7670 + (ck * 37) % 17000) AS INT) AS DAYS_BIRTH,
  CAST(CASE WHEN k % 6 = 0 THEN 365243 ELSE -((k * 13) % 12000) END AS INT) AS DAYS_EMPLOYED,
  CASE WHEN k % 2 = 0 THEN NULL ELSE h1 / CAST(1000 AS DOUBLE) END AS EXT_SOURCE_1,
  CASE WHEN k % 211 = 0 THEN NULL ELSE h2 / CAST(1000 AS DOUBLE) END AS EXT_SOURCE_2,
  CASE WHEN k % 5 = 0 THEN NULL ELSE h3 / CAST(1000 AS DOUBLE) END AS EXT_SOURCE_3,
  CAST((ck % 70) + 1 AS DOUBLE) / CAST(1000 AS DOUBLE) AS REGION_POPULATION_RELATIVE,
  CASE WHEN k % 301 = 0 THEN NULL ELSE CAST(k % 7 AS DOUBLE) END AS OBS_30_CNT_SOCIAL_CIRCLE,
  CASE WHEN k % 301 = 0 THEN NULL ELSE CAST((k % 7) * (h2 % 2) AS DOUBLE) END AS DEF_30_CNT_SOCIAL_CIRCLE,
  CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(h3 % 6 AS DOUBLE) END AS AMT_REQ_CREDIT_BUREAU_YEAR,
  CASE WHEN ck % 400 = 0 THEN 'XNA' WHEN ck % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
  CASE WHEN ck % 199 = 0 THEN 'Maternity leave' ELSE seg END AS NAME_INCOME_TYPE,
  CASE WHEN pr LIKE '1%' THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE
FROM (
  SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice AS tp, o_orderpriority AS pr,
    c_acctbal AS bal, c_mktsegment AS seg,
    (o_orderkey * 7919) % 1000 AS h1, (o_orderkey * 104729) % 1000 AS h2,
    (o_orderkey * 1299709 + 17) % 1000 AS h3,
    (o_orderkey * 15485863 + o_custkey * 31 + 5) % 1009 AS h4
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS b"""

BUREAU = """
SELECT l_orderkey AS SK_ID_CURR, l_orderkey * 10 + l_linenumber AS SK_ID_BUREAU,
  CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'N' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
  CASE WHEN l_linestatus = 'F' THEN 'Consumer credit' ELSE 'Credit card' END AS CREDIT_TYPE,
  l_extendedprice AS AMT_CREDIT_SUM, l_extendedprice * l_discount AS AMT_CREDIT_SUM_DEBT,
  l_extendedprice * l_tax AS AMT_CREDIT_SUM_OVERDUE, CAST(l_quantity AS INT) AS CREDIT_DAY_OVERDUE
FROM {lineitem}"""

PREVIOUS = """
SELECT CAST(floor(event_id / CAST(2 AS DOUBLE)) AS BIGINT) AS SK_ID_CURR, event_id AS SK_ID_PREV,
  CASE event_type WHEN 'error' THEN 'Refused' WHEN 'click' THEN 'Canceled' WHEN 'view' THEN 'Unused offer'
    ELSE 'Approved' END AS NAME_CONTRACT_STATUS,
  value * CAST(1000 AS DOUBLE) AS AMT_APPLICATION, value * CAST(900 AS DOUBLE) AS AMT_CREDIT,
  CASE WHEN user_id % 4 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE
FROM {events}"""

# The columns of the views, in order.
COLUMNS = {
    "applications": (
        "SK_ID_CURR TARGET AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY DAYS_BIRTH DAYS_EMPLOYED EXT_SOURCE_1 EXT_SOURCE_2 "
        "EXT_SOURCE_3 REGION_POPULATION_RELATIVE OBS_30_CNT_SOCIAL_CIRCLE DEF_30_CNT_SOCIAL_CIRCLE "
        "AMT_REQ_CREDIT_BUREAU_YEAR CODE_GENDER NAME_INCOME_TYPE NAME_CONTRACT_TYPE"
    ).split(),
    "bureau": (
        "SK_ID_CURR SK_ID_BUREAU CREDIT_ACTIVE CREDIT_TYPE AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_OVERDUE "
        "CREDIT_DAY_OVERDUE"
    ).split(),
    "previous_application": (
        "SK_ID_CURR SK_ID_PREV NAME_CONTRACT_STATUS AMT_APPLICATION AMT_CREDIT NAME_CONTRACT_TYPE"
    ).split(),
}
VIEWS = {"applications": APPLICATIONS, "bureau": BUREAU, "previous_application": PREVIOUS}
SOURCES = ("orders", "customer", "lineitem", "events")


def as_ctes() -> str:
    """The views as common table expressions over tables of the plain names."""
    names = {s: s for s in SOURCES}
    return ",\n".join(f"{name} AS ({text.format(**names)})" for name, text in VIEWS.items())


class Tables:
    """The loan tables over one folder of test tables, each bound when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self._dir = sf_dir.rstrip("/")

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {s: self.spark.read.parquet(f"{self._dir}/{s}.parquet") for s in SOURCES if f"{{{s}}}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def applications(self) -> DataFrame:
        return self._view("applications")

    @cached_property
    def bureau(self) -> DataFrame:
        return self._view("bureau")

    @cached_property
    def previous_application(self) -> DataFrame:
        return self._view("previous_application")

    def named(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in VIEWS}
