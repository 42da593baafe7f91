"""Running totals over groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import materialise

#: Cells that a uniform key is cut into.
CELLS = 4096


def hash_cell(key: Column, cells_bits: int = 12) -> Column:
    """The cell of a hexadecimal hash; it rises with the hash."""
    digits = (cells_bits + 3) // 4
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def running_totals(
    df: DataFrame, by: Sequence[str], cell: str, order: Sequence[str], value: str, before: str, whole: str
) -> DataFrame:
    """Add the total of ``value`` over earlier rows of the group, and over the group.

    ``cell`` is a number that never falls along ``order``. Each task sorts rows
    of single cells; what lies before a cell comes from the cells' totals, of
    which a group has at most as many as cells. Group columns must not be null.
    """
    keys = [*by, cell]
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cells = df.groupBy(*keys).agg(F.sum(value).alias("_cell_total"))
    cells = cells.select(
        *keys,
        (F.sum("_cell_total").over(group.orderBy(cell)) - F.col("_cell_total")).alias("_cells_before"),
        F.sum("_cell_total").over(group).alias(whole),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        placed.join(cells, keys)
        .withColumn(before, F.col("_cells_before") + F.col("_inside"))
        .drop("_cells_before", "_inside")
    )


def range_sorted(df: DataFrame, order: Sequence[str], cell: str, name: str) -> DataFrame:
    """Deal rows out by ranges of ``order`` and write them with their range's number."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).withColumn(cell, F.spark_partition_id())
    return materialise(ranged, name)
