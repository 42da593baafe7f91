"""Quality rules whose cutoffs are certified on labelled documents.

Each rule is a ratio of a document (symbols a word, repeated lines a word,
repeated words a word, characters a word) and a ladder of cutoffs from lenient to
strict. In every stratum (language) the good labelled documents tell how many a
cutoff would wrongly reject. The rules share the stratum's ``risk`` evenly, so
that their joint verdict stays within it however the rules overlap. A cutoff is
certified if the count is so low that a false rejection rate of ``risk / rules``
would have given it with a probability of at most ``level / (rules * strata)``
(exact binomial tail; Bonferroni over rules and strata). The ladder is tested from its lenient end and stops at the first cutoff
that fails, so its length costs nothing (fixed sequence). The strictest certified
cutoff is used; a rule without one rejects nothing in that stratum.

Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import materialise

SPACES = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = "[^#*$%&|<>]+"

#: Rule: (sign, ladder). The rule rejects if sign * ratio > sign * cutoff.
RULES: Mapping[str, tuple[int, Sequence[float]]] = {
    "symbols_per_word": (1, (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines_per_word": (1, (0.2, 0.1, 0.05, 0.02)),
    "repeats_per_word": (1, (0.45, 0.4, 0.35, 0.3)),
    "chars_per_word": (1, (12.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
}
#: Bound on the rate of good documents that the rules may reject together in a stratum, and the chance that any bound fails.
RISK, LEVEL = 0.02, 0.05


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """How many words stand in three-word windows found twice or more.

    Windows sort by their words, so equal ones become neighbours; every window
    equal to a neighbour marks its three places.
    """
    third = F.size(words) - 2

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), third),
            lambda i: F.struct(
                F.element_at(w, i).alias("a"),
                F.element_at(w, i + 1).alias("b"),
                F.element_at(w, i + 2).alias("c"),
                i.cast("int").alias("i"),
            ),
        )

    def marked(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1),
            F.slice(s, F.lit(2), F.size(s) - 1),
            lambda x, y: F.when(
                (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]),
                F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2),
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(F.sort_array(windows(words)), marked))


def base_measures(text: Column) -> dict[str, Column]:
    """Counts of a text; a null text has none.

    ``_words`` must be a column made by ``words_of`` beforehand.
    """
    clean = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(clean, SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(clean, NOT_SYMBOLS, "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(F.col("_words")).cast("long"),
    }


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def measured(docs: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """``keep`` of every row with the base measures and the base verdict."""
    base = docs.select(*keep, F.col("text").alias("_text"), words_of(F.col("text")).alias("_words"))
    rows = base.select(
        *[c for c in base.columns if c not in ("_text", "_words")],
        *[c.alias(name) for name, c in base_measures(F.col("_text")).items()],
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", failed)


def ratios() -> dict[str, Column]:
    words = F.col("n_words").cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "repeats_per_word": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def binomial_tail(rejected: Column, good: Column, risk: float) -> Column:
    """P(X <= rejected) for X binomial(good, risk), summed term by term in logarithms."""
    odds = F.log(F.lit(risk / (1 - risk)))
    first = good * F.log(F.lit(1 - risk))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((good - j + 1) / j) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    start = F.struct(first.alias("term"), F.exp(first).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), rejected), start, step, lambda acc: acc["total"])
    return F.when(rejected == 0, F.exp(first)).otherwise(tail)


def certified_cutoffs(
    measures: DataFrame,
    labels: DataFrame,
    rules: Mapping[str, tuple[int, Sequence[float]]] = RULES,
    risk: float = RISK,
    level: float = LEVEL,
) -> DataFrame:
    """A row for each stratum with a cutoff (or null) for every rule.

    ``measures`` has doc_id, stratum, the base measures and base_failed;
    ``labels`` has doc_id and quality. Good documents are those of quality 1
    that pass the base. Every document is one trial, whether its row or its label
    is repeated; of several rows in a stratum the worst one counts.
    """
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_labelled"))
    rows = measures.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_labelled"), "left_semi")
    ratio = ratios()
    worst = [F.max(F.lit(sign) * ratio[rule]).alias(f"_{rule}") for rule, (sign, _) in rules.items()]
    rows = rows.groupBy("stratum", "doc_id").agg(*worst)
    sums = [
        F.sum((F.col(f"_{rule}") > F.lit(sign * cutoff)).cast("long")).alias(f"{rule}_{i}")
        for rule, (sign, ladder) in rules.items()
        for i, cutoff in enumerate(ladder)
    ]
    counts = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("_good"), *sums)
    counts = counts.withColumn("_strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    share, risk = F.lit(level) / (F.col("_strata") * len(rules)), risk / len(rules)

    def passes(name: str) -> Column:
        enough = F.col(name) <= F.col("_good") * F.lit(risk)
        return F.when(enough, binomial_tail(F.col(name), F.col("_good"), risk) <= share).otherwise(F.lit(False))

    def strictest(rule: str, ladder: Sequence[float]) -> Column:
        rungs = F.array(
            *[F.struct(passes(f"{rule}_{i}").alias("ok"), F.lit(float(c)).alias("cutoff")) for i, c in enumerate(ladder)]
        )
        climbed = F.aggregate(
            rungs,
            F.struct(F.lit(True).alias("open"), F.lit(None).cast("double").alias("cutoff")),
            lambda acc, rung: F.struct(
                (acc["open"] & rung["ok"]).alias("open"),
                F.when(acc["open"] & rung["ok"], rung["cutoff"]).otherwise(acc["cutoff"]).alias("cutoff"),
            ),
            lambda acc: acc["cutoff"],
        )
        return climbed.alias(f"{rule}_cutoff")

    found = counts.select(
        "stratum", F.col("_good").alias("good"), *[strictest(rule, ladder) for rule, (_, ladder) in rules.items()]
    )
    # Written, its size is known: a join broadcasts it only if it is small, and then shuffles no documents.
    return materialise(found, "quality-cutoffs")


def judge(
    measures: DataFrame,
    cutoffs: DataFrame,
    rules: Mapping[str, tuple[int, Sequence[float]]] = RULES,
) -> DataFrame:
    """Add kept: false if the base failed or a certified rule of the stratum rejects."""
    joined = measures.join(cutoffs.drop("good"), "stratum", "left")
    ratio = ratios()
    rejected = F.lit(False)
    for rule, (sign, _) in rules.items():
        beyond = F.lit(sign) * ratio[rule] > F.lit(sign) * F.col(f"{rule}_cutoff")
        rejected = rejected | F.coalesce(beyond, F.lit(False))
    return joined.withColumn("kept", ~(F.col("base_failed") | rejected))


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n"))


def score_quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, lang).

    Returns doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and the cutoffs of the row's language. A
    null or empty text has no words and fails the base; a null lang is a
    stratum of its own; a null doc_id has no label but gets a verdict. Repeated
    rows are judged alike. Without labels only the base rejects. An empty table
    gives no rows. Other columns are not read.
    """
    measures = materialise(measured(docs, [F.col("doc_id"), F.col("lang"), _stratum().alias("stratum")]), "quality")
    return judge(measures, certified_cutoffs(measures, labels, risk=risk, level=level)).drop("stratum")


def good_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, with all their columns.

    The columns travel in one struct, so their names can't clash.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    measures = materialise(
        measured(docs, [F.col("doc_id"), _stratum().alias("stratum"), carried]), "quality-documents"
    )
    judged = judge(measures, certified_cutoffs(measures, labels, risk=risk, level=level))
    return judged.filter("kept").select("_doc.*")
