"""Loan tables stored as Parquet, optionally bucketed by borrower."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from creditloom.fixed import ID
from creditloom.sources import versions
from creditloom.sources.schemas import SCHEMAS

#: The rows of a published table, inside its version.
DATA = "data"


def load_tables(spark: SparkSession, folder: str, names: Iterable[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The published tables, all three unless named, under ``folder/<table>``; plain Parquet tables are read as well."""
    root, out = folder.rstrip("/"), {}
    for name in names:
        version = versions.current(spark, f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}" if version is None else f"{version}/{DATA}")
    return out


def load_manifest(spark: SparkSession, folder: str, names: Iterable[str] = tuple(SCHEMAS)) -> DataFrame:
    """``(table_name, row_count)`` of the published tables, as counted when they were written; nothing is scanned."""
    found = {name: versions.current(spark, f"{folder.rstrip('/')}/{name}") for name in names}
    rows = [(name, versions.manifest(spark, path)["rows"]) for name, path in found.items() if path is not None]
    return spark.createDataFrame(rows, "table_name string, row_count long")


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables known to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def save_bucketed(tables: Mapping[str, DataFrame], folder: str, buckets: int, prefix: str = "") -> None:
    """Save as catalog tables bucketed and sorted by borrower.

    Joins and aggregations on the borrower then need no shuffle. Rows are dealt
    out by bucket first, so that each bucket is one sorted file. Choose the
    bucket count so that a bucket of the largest table fits a task. All records
    of a borrower are in one bucket: one with a third of all records makes a
    bucket of that size, which reading splits but writing does not; leave such
    a table unbucketed, adaptive joins split it.
    """
    for name, df in tables.items():
        (
            df.repartition(buckets, ID)
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(buckets, ID)
            .sortBy(ID)
            .option("path", f"{folder.rstrip('/')}/{prefix}{name}")
            .saveAsTable(f"{prefix}{name}")
        )
