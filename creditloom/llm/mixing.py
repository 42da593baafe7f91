"""Mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded order, followed by the same
documents again, as often as repeats are allowed. A document's virtual finish
time is the words of its queue up to and with it, divided by the weight of the
source. Sorting all queues by finish time and stopping at the total budget serves
the sources in proportion to their weights; a queue that runs dry leaves the rest
to the others, which is exactly the resharing of the excess by weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.ranks import hash_cell, range_sorted, running_totals
from creditloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeated; null comes last.
WEIGHTS = (3, 1, 2)


def _stratum() -> Column:
    """A source's name behind a letter that puts null last."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("z"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """Weight and target of every source; ``sizes`` has a row for each (_stratum, source_size).

    Targets are ``weight * level``, at most ``repeats`` times the source. A
    source is full if raising all that are no emptier to its own level still
    fits the budget; the level follows from what the full ones leave.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("_stratum")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    limit = F.col("source_size").cast("double") * repeats
    weighed = sizes.withColumn("_weight", pick).withColumns({"_limit": limit, "_fill": limit / F.col("_weight")})
    earlier = everything.orderBy("_fill", "_stratum").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum(F.col("source_size").cast("double")).over(everything) * share
    weighed = weighed.withColumns(
        {
            "_budget": budget,
            "_given": F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0)),
            "_open": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0.0)),
        }
    )
    full = F.col("_given") + F.col("_fill") * F.col("_open") <= F.col("_budget")
    weighed = weighed.withColumn("_full", full)
    left = F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0.0)).over(everything)
    sharing = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(everything)
    level = F.when(sharing > 0, left / sharing)
    return weighed.withColumn("_level", level).select(
        "_stratum",
        "source_size",
        "_weight",
        "_budget",
        F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_weight") * F.col("_level")).alias("target"),
    )


def _queue(
    docs: DataFrame, weights: Sequence[int], share: float, repeats: int, seed: str, carry: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbered rows of ``docs``, the targets of the sources, and the numbers of taken rows with their words."""
    rows = materialise(
        docs.select(
            "doc_id",
            "source",
            _stratum().alias("_stratum"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key"),
            F.monotonically_increasing_id().alias("_row"),
            *carry,
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("_stratum").agg(F.sum("size").alias("source_size"))
    # Written, its size is known: a join broadcasts it only if it is small, and then shuffles no rows.
    targets = materialise(source_targets(sizes, weights, share, repeats), "mix-targets")
    queued = (
        rows.filter(F.col("size") > 0)
        .select("_row", "_stratum", "size", "_key", "doc_id")
        .withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
        .withColumn("_cell", F.col("_pass") * F.lit(1 << 12) + hash_cell(F.col("_key")))
    )
    ordered = running_totals(
        queued, ["_stratum"], "_cell", ["_pass", "_key", "doc_id", "size"], "size", "_before", "_queue"
    )
    finish = (F.col("_before") + F.col("size")).cast("double") / F.col("_weight")
    timed = ordered.join(targets.select("_stratum", "_weight", "_budget"), "_stratum").select(
        "_row", "_stratum", "_pass", "_key", "doc_id", "size", "_budget", finish.alias("_finish")
    )
    line = ["_finish", "_stratum", "_pass", "_key", "doc_id", "size"]
    lined = running_totals(range_sorted(timed, line, "_range", "mix-line"), [], "_range", line, "size", "_served", "_all")
    taken = (
        lined.filter(F.col("_served") + F.col("size") <= F.col("_budget"))
        .groupBy("_row")
        .agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("_times"))
    )
    return rows, targets.drop("_weight", "_budget"), taken


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix-0",
) -> DataFrame:
    """How many words of every row of ``docs`` (doc_id, text, source) the mix takes.

    Returns doc_id, source, size (words), source_size, target (words the source
    should give) and taken (words it gives here, repeats counted: 0, once or up
    to ``repeats`` times the size). Sources in code point order, null last, have
    the ``weights`` in turn and share ``share`` times all words; no source gives
    more than ``repeats`` times its words. Null and empty texts have no words and
    are not taken. Rows with one doc_id are ordered by size, equal ones are
    interchangeable; a null doc_id is shuffled like the word ``null``. An empty
    table gives no rows. Other columns are not read.
    """
    rows, targets, taken = _queue(docs, weights, share, repeats, seed, [])
    return rows.join(targets, "_stratum").join(taken, "_row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix-0",
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Rules as for ``mix``. Columns of ``docs`` keep their names and types, except
    that names used inside (starting with ``_``, ``size`` and ``taken``) are
    safe too: the columns travel in one struct.
    """
    packed = docs.select(
        F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    )
    rows, _, taken = _queue(packed, weights, share, repeats, seed, ["_doc"])
    copies = rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return copies.select("_doc.*")
