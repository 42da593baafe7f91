"""Spelling variants, found by searching a trie of letter-group counts.

Letters are dealt into ``GROUPS`` groups. A word's vector is its length followed
by how many of its letters fall into each group; the trie's levels are the
numbers of that vector. One inserted letter raises one count by one (a surplus),
a deleted one lowers one (a deficit), a replaced one does either both or nothing.
So a depth-first search that may spend one surplus and one deficit reaches the
leaf of every word one edit away, and the words of the leaves it reaches are
verified letter by letter.

The first levels decide in which task a subtree lives; how many they are follows
from the counts, so that a subtree has ``SUBTREE`` words at most. A word goes to
its own subtree, and asks in those that its budget can reach and that come behind
its own in the order of their names, at most ``1 + 2 depth + depth (depth - 1) / 2``
others; what it finds there counts for both words. In a task all words descend
together. Where the whole vector is not enough, the words of a leaf are cut by a
hash, and so are those that ask there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.session import discard, materialise

#: Runs of letters, and the letters that are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One run in ``DAMAGED`` loses a letter.
DAMAGED = 31
#: Letters of a word, and its occurrences, at least.
SHORTEST, RAREST = 7, 2
#: A form is this many times as frequent as its variant, so a chain of forms has fewer steps than a long has digits.
TIMES = 10
_DOUBLINGS = 5
#: Letter groups: code points modulo ``GROUPS``, those with frequent letters (e n t a i s r o l h m) first.
GROUPS = 16
_FREQUENT = [ord(c) % GROUPS for c in "entaisrolhm"]
ORDER = [*_FREQUENT, *(g for g in range(GROUPS) if g not in _FREQUENT)]
#: A node with so few pairs of words left is verified at once.
FEW = 1 << 11
#: Words of a task's subtree, and words that ask in it at once.
SUBTREE = 1 << 15
#: Distinct words whose counts a task holds before it passes them on.
_COUNTED = 1 << 18


def damaged(doc_id: int | None, run: str, start: int | None = None) -> str:
    """The lower-cased run, without one letter where the hash of document and run asks for it."""
    if start is None:
        start = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    number = zlib.crc32(run.encode(), start)
    if number % DAMAGED:
        return run
    at = number % len(run)
    return run[:at] + run[at + 1 :]


def _counts(shortest: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                for run, n in Counter(RUN.findall((text.as_py() or "").translate(_LOWER))).items():
                    # A run that is too short stays so without a letter.
                    if len(run) >= shortest:
                        word = damaged(doc_id, run, start)
                        if len(word) >= shortest:
                            total[word] += n
            if len(total) >= _COUNTED:
                yield told()
                total.clear()
        if total:
            yield told()

    return counted


def word_counts(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """The words of ``docs`` (doc_id, text) that occur often enough, with their counts."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = thin.mapInArrow(_counts(shortest), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def group_of(letters: np.ndarray) -> np.ndarray:
    """The group of each letter, by its code point."""
    return np.argsort(ORDER)[letters % GROUPS]


def vectors_of(words: list[str]) -> np.ndarray:
    """Length and counts of the letter groups of each word, one row each."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = group_of(np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64))
    rows = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(rows * GROUPS + letters, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return np.concatenate([lengths[:, None], counts], axis=1)


def reachable(vector: list[int], depth: int) -> list[list[int]]:
    """The subtrees, named by a length and ``depth`` counts, that may hold words one edit away.

    The word's own comes first; of the others only those behind it, for a near
    word in front of it reaches the word itself.
    """
    length, counts = vector[0], vector[1 : depth + 1]

    def moved(*steps: tuple[int, int]) -> list[int]:
        new = list(counts)
        for place, step in steps:
            new[place] += step
        return new

    places = range(depth)
    up = [moved((i, 1)) for i in places]
    # Of the replacements that change two counts, those that raise the first of the two.
    both = [moved((i, 1), (j, -1)) for i in places for j in places if i < j]
    return [[length, *counts]] + [
        [n, *x] for n, some in ((length, up + both), (length + 1, [counts, *up])) for x in some if min(x, default=0) >= 0
    ]


def _placed(depth: int):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            vectors = vectors_of(words)
            where = [reachable(v, depth) for v in vectors.tolist()]
            sizes = [len(x) for x in where]
            rows = np.repeat(np.arange(len(words)), sizes)
            flat = [x for some in where for x in some]
            own = np.zeros(len(rows), bool)
            own[np.cumsum([0, *sizes[:-1]])] = True
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([".".join(map(str, x)) for x in flat], pa.string()), pa.array(own), kept.column("word"), kept.column("n")],
                names=["subtree", "own", "word", "n"],
            )

    return placed


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one inserted, deleted or replaced letter."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(axis=1) == 1
    if left.shape[1] > right.shape[1]:
        left, right = right, left
    # The shorter word is a beginning of the longer one followed by an end of it, one letter apart.
    length = left.shape[1]
    start = np.cumprod(left == right[:, :length], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    end = np.cumprod((left == right[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return start + end >= length


class Trie:
    """Words in the order of their vectors; a node is a range of them and a level."""

    def __init__(self, words: list[str]) -> None:
        vectors = vectors_of(words) if words else np.empty((0, GROUPS + 1), np.int64)
        self.order = np.lexsort(vectors.T[::-1])
        self.vectors = vectors[self.order]
        self.words = [words[i] for i in self.order]

    def search(self, asking: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in ``asking``, place in the given words) one edit apart, leaf by leaf."""
        if not asking or not self.words:
            return
        wanted = vectors_of(asking)
        every = np.arange(len(asking))
        spent = np.zeros(len(asking), np.int8)
        # A node waits with those who reach it and what they have spent: 1 a surplus, 2 a deficit.
        stack = [(0, len(self.words), 0, every, spent)]
        while stack:
            low, high, level, who, spent = stack.pop()
            if level == wanted.shape[1] or (level and (high - low) * len(who) <= FEW):
                yield from self._verified(asking, low, high, who)
                continue
            column = self.vectors[low:high, level]
            values, starts = np.unique(column, return_index=True)
            asked = wanted[who, level]
            for i, value in enumerate(values.tolist()):
                gap = value - asked
                cost = np.where(gap > 0, 1, np.where(gap < 0, 2, 0)).astype(np.int8)
                # The length is no letter group: it says which budget there is instead of spending it.
                if level == 0:
                    fine = np.abs(gap) <= 1
                    cost = np.where(gap == 0, 0, 3 - cost).astype(np.int8)
                else:
                    fine = (np.abs(gap) <= 1) & (spent & cost == 0)
                if fine.any():
                    end = starts[i + 1] if i + 1 < len(starts) else high - low
                    stack.append((low + int(starts[i]), low + int(end), level + 1, who[fine], (spent | cost)[fine]))

    def _verified(self, asking: list[str], low: int, high: int, who: np.ndarray) -> Iterator[tuple]:
        leaf = letters_of(self.words[low:high], len(self.words[low]))
        lengths = np.array([len(asking[i]) for i in who])
        for length in np.unique(lengths).tolist():
            some = who[lengths == length]
            # So many pairs at once that their letters stay within some megabytes.
            step = max(1, (1 << 22) // max(1, length * (high - low)))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                letters = letters_of([asking[j] for j in part], length)
                a, b = np.repeat(np.arange(len(part)), high - low), np.tile(np.arange(high - low), len(part))
                near = one_edit(letters[a], leaf[b])
                yield part[a[near]], self.order[low + b[near]]


_NEAR = "word string, n_near long, form_n long, form string"


def _searched(key: tuple, rows: pa.Table) -> pa.Table:
    """The words that meet in one subtree: how many near ones each has there, and the most frequent of them.

    A word that asks at home is found by the others there in turn; one that asks
    elsewhere is told to those it finds.
    """
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    own = np.flatnonzero(rows.column("own").to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
    trie = Trie([words[i] for i in own])
    found = [(asks[a], own[b]) for a, b in trie.search([words[i] for i in asks])]
    none = np.empty(0, np.int64)
    a, b = np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(x for _, x in found)])
    away = ~rows.column("home").to_numpy(zero_copy_only=False)[a]
    a, b = np.concatenate([a, b[away]]), np.concatenate([b, a[away]])
    # The first row of each word that asks is its most frequent near word, the smallest of equals.
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -counts[b], a))
    a, b = a[order], b[order]
    first, n_near = np.unique(a, return_index=True, return_counts=True)[1:]
    return pa.table(
        [
            pa.array([words[i] for i in a[first]], pa.string()),
            pa.array(n_near, pa.int64()),
            pa.array(counts[b[first]], pa.int64()),
            pa.array([words[i] for i in b[first]], pa.string()),
        ],
        names=[c.split()[0] for c in _NEAR.split(", ")],
    )


def _vector_columns() -> list[Column]:
    """The numbers of a word's vector as columns, for counting only."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.pmod(F.ascii(c), F.lit(GROUPS)))

    def held(group: int) -> Column:
        return F.size(F.filter(codes, lambda x: x == group))

    counts = [held(g).alias(f"c{i}") for i, g in enumerate(ORDER)]
    return [F.length("word").alias("length"), *counts]


def subtree_depth(words: DataFrame, subtree: int = SUBTREE) -> int:
    """Counts that name a subtree: as few as keep the largest at ``subtree`` words, or all of them."""
    names = ["length", *(f"c{g}" for g in range(GROUPS))]
    sizes = words.select(*_vector_columns()).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes, "variants-leaves")
    for depth in range(GROUPS):
        largest = sizes.groupBy(*names[: depth + 1]).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= subtree:
            return depth
    return GROUPS


def near_words(words: DataFrame, subtree: int = SUBTREE, depth: int | None = None) -> DataFrame:
    """For every word with near words of ``words`` (word, n): their number, and the most frequent with its count."""
    depth = subtree_depth(words, subtree) if depth is None else depth
    placed = materialise(words.select("word", "n").mapInArrow(_placed(depth), _PLACED), "variants-placed")
    # Subtrees are few beside the words, and only those with more words than a task takes are cut.
    sizes = placed.groupBy("subtree").agg(F.count_if("own").alias("own_n"), F.count(F.lit(1)).alias("ask_n"))
    parts = [F.ceil(F.col(c) / subtree).cast("int").alias(p) for c, p in (("own_n", "owners"), ("ask_n", "askers"))]
    sizes = sizes.filter("own_n > 0").select("subtree", *parts)
    rows = placed.join(sizes, "subtree")

    def slot(parts: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(parts).cast("long")).cast("int")

    def meeting(owner: Column, asker: Column, asks: bool) -> Column:
        return F.struct(owner.alias("owner"), asker.alias("asker"), F.lit(asks).alias("asks"))

    def upto(parts: str) -> Column:
        return F.sequence(F.lit(0), F.col(parts) - 1)

    asking = F.transform(upto("owners"), lambda x: meeting(x, slot("askers"), True))
    owning = F.transform(upto("askers"), lambda x: meeting(slot("owners"), x, False))
    # A subtree that is not cut gets one row of a word that owns and asks there.
    whole = (F.col("owners") == 1) & (F.col("askers") == 1)
    at_home = F.when(whole, asking).otherwise(F.concat(owning, asking))
    met = F.explode(F.when(F.col("own"), at_home).otherwise(asking)).alias("at")
    met = rows.select("subtree", "word", "n", F.col("own").alias("home"), whole.alias("whole"), met)
    met = met.select("subtree", "word", "n", "home", "at.*", (F.col("home") & (F.col("whole") | ~F.col("at.asks"))).alias("own"))
    found = met.groupBy("subtree", "owner", "asker").applyInArrow(_searched, _NEAR)
    # Strings are ordered by their UTF-8 bytes, which is the order of code points.
    best = F.min_by(F.struct("form", "form_n"), F.struct((-F.col("form_n")).alias("n"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    found = materialise(found.select("word", "n_near", "best.form", "best.form_n"), "variants-near")
    discard(placed)
    return found


_PLACED = "subtree string, own boolean, word string, n long"


def spelling_variants(
    docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, times: int = TIMES, subtree: int = SUBTREE
) -> DataFrame:
    """The words of ``docs`` (doc_id, text), each with the form that it may be a variant of.

    Words are the runs of letters of whole texts, A to Z in lower case, one in 31
    without one of its letters (as a hash of document and run says), if they have
    at least ``shortest`` letters and occur ``rarest`` times. Two words are near if
    they are one inserted, deleted or replaced letter apart. Returns word, form
    (the near word of the largest count, the smallest of ties, if that is ``times``
    times the word's own count, else null), root (where following forms ends; the
    word itself without a form), n, n_near and form_n (null without a form).

    Null and empty texts have no words. A null doc_id hashes like an empty string.
    Repeated rows count as often as they are there. Texts and words of any length
    are taken whole. An empty table gives no rows. Other columns are not read.
    """
    words = materialise(word_counts(docs, shortest, rarest), "variants-words")
    near = near_words(words, subtree)
    enough = F.col("form_n") >= F.col("n") * times
    told = words.join(near, "word", "left").select(
        "word",
        F.when(enough, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("form_n")).alias("form_n"),
    )
    told = materialise(told, "variants-told")
    steps = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(_DOUBLINGS):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        steps = materialise(
            steps.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")),
            "variants-steps",
        )
    return told.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
