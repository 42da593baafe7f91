"""Deterministic samples, caps and splits that do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.fixed import ID, SEED, TARGET, TEST_SHARE
from creditloom.functions.keys import shuffle_key
from creditloom.operators.ranking import mark_first


def stratified_sample(
    df: DataFrame, sizes: Mapping[int, int], label: str = TARGET, key: str = ID, seed: int = SEED
) -> DataFrame:
    """Exactly ``sizes[c]`` rows of each class, without replacement.

    Asking for more rows than a class has is an error.
    """

    def quota(value: int, rows: int) -> int:
        if sizes[value] > rows:
            raise ValueError(f"cannot sample {sizes[value]} rows of {label}={value}, there are {rows}")
        return sizes[value]

    marked = mark_first(df, shuffle_key(key, seed), key, quota, label, list(sizes))
    return marked.where("selected").drop("selected")


def proportional_sizes(
    df: DataFrame, n: int, label: str = TARGET, classes: Sequence[int] = (0, 1)
) -> dict[int, int]:
    """Sample sizes that keep the class shares of ``df``."""
    rows = df.where(F.col(label).isin(*classes)).groupBy(label).count().collect()
    total = sum(r[1] for r in rows)
    return {r[0]: round(n * r[1] / total) for r in rows}


def subset_children(child: DataFrame, sampled: DataFrame, key: str = ID) -> DataFrame:
    """Child rows whose borrower was sampled.

    A plain semi join: adaptive execution sees the real size of the identifiers
    and broadcasts them only if they are few.
    """
    return child.join(sampled.select(key), key, "left_semi")


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out


def with_shuffle_key(df: DataFrame, key: str = ID, seed: int = SEED, name: str = "shuffle_key") -> DataFrame:
    """The order a shuffle would give, as a column: a frame has no row order to change."""
    return df.withColumn(name, shuffle_key(key, seed))


def deterministic_cap(df: DataFrame, n: int | None = None, key: str = ID, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows, always the same ones; all rows when ``n`` is None.

    Rows without an identifier come first in the order, so they count like others.
    """
    if n is None:
        return df
    marked = mark_first(df, shuffle_key(key, seed), key, lambda _, rows: min(n, rows))
    return marked.where("selected").drop("selected")


def stratified_split(
    df: DataFrame,
    label: str = TARGET,
    test_share: float = TEST_SHARE,
    key: str = ID,
    seed: int = SEED,
    classes: Sequence[int] = (0, 1),
) -> DataFrame:
    """Add ``is_test``: per class the first ``ceil(test_share * n)`` rows in shuffled order."""
    def quota(_: object, rows: int) -> int:
        return math.ceil(round(test_share * rows, 9))

    return mark_first(df, shuffle_key(key, seed), key, quota, label, list(classes)).withColumnRenamed(
        "selected", "is_test"
    )
