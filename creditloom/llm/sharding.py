"""Shards that all hold the corpus's mixture of sources.

Rows of a source are shuffled by a seeded hash and ranked; a row's place is its
fractional rank ``(rank + 1/2) / rows of the source``. Sorting all rows by that
place interleaves the sources in proportion, and cutting the sequence into equal
runs gives shards whose row counts, and whose rows of every source, differ by
about one. Only built-in functions are used, and only identifiers, sources and
sizes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.ranks import CELLS, hash_cell, running_totals
from creditloom.session import materialise


def assign_shards(docs: DataFrame, shards: int = 24, seed: str = "shard-0") -> DataFrame:
    """A shard and a place in it for every row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size (UTF-8 bytes and 8), text_crc32, law ``rows``,
    shard, slot (from 0 without gaps) and grown_shard (null: the law is not by
    key). A null text counts as empty, a null source is a source, a null doc_id
    is shuffled like the word ``null``. Rows with the same doc_id are ordered by
    checksum and size; whole copies are interchangeable. An empty table gives no
    rows; with fewer rows than shards some shards stay empty. Other columns of
    ``docs`` are not read.
    """
    text = F.coalesce("text", F.lit(""))
    thin = materialise(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_stratum"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key"),
        ),
        "shard-rows",
    )
    keyed = thin.withColumns({"_cell": hash_cell(F.col("_key")), "_one": F.lit(1).cast("long")})
    ranked = running_totals(
        keyed, ["_stratum"], "_cell", ["_key", "doc_id", "text_crc32", "size"], "_one", "_rank", "_rows"
    )
    placed = ranked.withColumn("_place", (F.col("_rank") + F.lit(0.5)) / F.col("_rows"))
    placed = placed.withColumn("_cell", F.floor(F.col("_place") * CELLS)).drop("_key", "_rank", "_rows")
    lined = running_totals(placed, [], "_cell", ["_place", "_stratum"], "_one", "_position", "_total")
    shard = F.expr(f"_position * {shards} div _total")
    start = F.expr(f"(_shard * _total + {shards - 1}) div {shards}")
    return lined.withColumn("_shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_position") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
