"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from checks import ORACLE, QUERIES
from checks.compare import compare, connect

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck(small_dir):
    return connect(small_dir)


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["dimension", "segment"]


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) <= set(entry_module.queries())


def test_oracle_names_are_registered():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, small_dir, name):
    ok, note = compare(spark, duck, small_dir, name)
    assert ok, note
