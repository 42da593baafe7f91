"""Alignment of two tokenizers over the same text.

Tokens of either side are byte ranges of the text behind one space. No token of
either side spans the border in front of a space that a word follows, so a text
is cut there, and a chunk of whole documents is a list of words. Its distinct
words are aligned at once, as one row of arrays:

- every token points to its farthest-right overlapping token, the one of the
  other side that covers its last byte; a token of the first side whose end is
  also an end of the other side points to itself;
- successors are doubled, all tokens at once, until nothing changes, so that the
  longest chain costs the logarithm of its length in rounds. A component's tokens
  then point to its last token of the first side, which labels the group.

Two ranges overlap in one piece, so the links of a word are the pieces that the
ends of both sides cut it into. Their counts over the corpus are summed chunk by
chunk first: a pair that is everywhere is one row a chunk. The counts return to
the chunks the same way, and the documents' sums are taken there.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.session import materialise

#: Characters of text from which a chunk is full, and characters that are tokenized at once. Longer ones stay whole.
CHUNK, AT_ONCE = 1 << 20, 1 << 16
#: Words that a worker remembers before it forgets them all, and letters of them.
_REMEMBERED, _LETTERS_HELD = 1 << 18, 1 << 23
#: The spaces in front of words that a text is cut at. U+2581 stands for a space in sentencepiece models.
_BORDER = re.compile(r"(?<![ \u2581]) (?=[^\s\u2581])")
#: Words that are letters, with signs behind them, in every version of Unicode's tables.
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]*)")


class Side(NamedTuple):
    """A tokenizer: the bytes of each id, how to encode texts, and whether borders of words end its tokens."""

    pieces: list[bytes]
    lengths: np.ndarray
    encode: Callable[[list[str]], list[list[int]]]
    cuts: bool


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes in: printable Latin ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _side(pieces: list[bytes], encode: Callable, cuts: bool) -> Side:
    return Side(pieces, np.array([len(p) for p in pieces], np.int64), encode, cuts)


def byte_level_side(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; special strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["id"] for t in spec["added_tokens"]}
    names = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}
    pieces = [
        names[i].encode() if i in added else bytes(letters[c] for c in names[i]) if i in names else b""
        for i in range(max(names) + 1)
    ]
    # The usual splitting starts a new pre-token at every space that something else than white space follows.
    steps = spec["pre_tokenizer"] or {}
    usual = steps.get("type") == "ByteLevel" and not steps["add_prefix_space"] and steps.get("use_regex", True)

    plain = usual and spec["normalizer"] is None
    spelled = {byte: letter for letter, byte in letters.items()}

    def merged(pre_token: str) -> list[int]:
        return [x.id for x in model.tokenize(pre_token.encode().decode("latin-1").translate(spelled))]

    def encode(texts: list[str]) -> list[list[int]]:
        # A space and letters are one pre-token and signs behind them another; the merges can be asked directly.
        found = [_LETTERS.fullmatch(t) if plain else None for t in texts]
        others = [" " + t for t, x in zip(texts, found, strict=True) if x is None]
        rest = iter(library.encode_batch_fast(others, add_special_tokens=False))
        return [
            next(rest).ids if x is None else merged(" " + x[1]) + merged(x[2]) if x[2] else merged(" " + x[1])
            for x in found
        ]

    model = library.model
    return _side(pieces, encode, plain)


def sentence_piece_side(path: str) -> Side:
    """A model file of the sentencepiece library, which adds the space itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        bytes([int(library.id_to_piece(i)[3:5], 16)])
        if library.is_byte(i)
        else library.id_to_piece(i).replace("▁", " ").encode()
        for i in range(library.get_piece_size())
    ]
    # Merges make pieces of the vocabulary only, and none goes on behind a letter with a space.
    cuts = not any(re.search("[^ ] ", library.id_to_piece(i).replace("▁", " ")) for i in range(len(pieces)))
    return _side(pieces, lambda texts: library.encode(texts, num_threads=1), cuts)


@functools.lru_cache(maxsize=2)
def sides(first: str, second: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once in every process."""
    return byte_level_side(first), sentence_piece_side(second)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every token of the first side and then of the second the last token of its component.

    ``ends_a`` and ``ends_b`` rise and have their last value in common.
    """
    to_b = np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    closed = ends_b[to_b] == ends_a
    ahead = np.concatenate([np.where(closed, np.arange(len(ends_a)), len(ends_a) + to_b), to_a])
    while True:
        further = ahead[ahead]
        if np.array_equal(further, ahead):
            return ahead
        ahead = further


def _per_word(ends: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the rising ``ends`` lie in each of the ranges between ``edges``."""
    return np.diff(np.searchsorted(ends, edges, side="right"))


class _Numbers(dict):
    """Distinct words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Words:
    """The aligned words that a worker knows: figures of each, its groups, and the id pairs of its links."""

    def __init__(self, first: Side, second: Side) -> None:
        self.both = first, second
        self.forget()

    def forget(self) -> None:
        self.numbers, self.letters = _Numbers(), 0
        self.good = np.empty(0, bool)
        self.figures = np.empty((4, 0), np.int64)
        self.groups: list[str] = []
        self.linked = np.empty(0, np.int64)

    @property
    def n_links(self) -> np.ndarray:
        return self.figures[3]

    def catch_up(self) -> None:
        """Align the words that were numbered since the last call."""
        words, part, size = islice(self.numbers, len(self.good), None), [], 0
        found = []
        for word in words:
            part.append(word)
            size += len(word)
            if size >= AT_ONCE:
                found.append(align(*self.both, part))
                self.letters += size
                part, size = [], 0
        if part:
            found.append(align(*self.both, part))
            self.letters += size
        self.good = np.concatenate([self.good, *(x.good for x in found)])
        self.figures = np.concatenate([self.figures, *(x.figures for x in found)], axis=1)
        self.linked = np.concatenate([self.linked, *(x.linked for x in found)])
        for x in found:
            self.groups += x.groups

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """The id pairs of the links of words, one word's behind another's."""
        sizes = self.n_links[numbers]
        starts = np.cumsum(self.n_links) - self.n_links
        before = np.cumsum(sizes) - sizes
        return self.linked[np.repeat(starts[numbers] - before, sizes) + np.arange(sizes.sum())]


class Aligned(NamedTuple):
    """Words that were aligned together; ``figures`` are the rows n_a, n_b, n_groups and n_links."""

    good: np.ndarray
    figures: np.ndarray
    groups: list[str]
    linked: np.ndarray


def _spelled(side: Side, ids: np.ndarray, counts: np.ndarray, want: list[bytes]) -> np.ndarray:
    """Whether each word is spelled byte for byte; words that are all right are compared at once."""
    ends = np.append(0, np.cumsum(side.lengths[ids]))[np.cumsum(counts)]
    spelled = b"".join(map(side.pieces.__getitem__, ids.tolist()))
    if np.array_equal(ends, np.cumsum([len(w) for w in want])) and spelled == b"".join(want):
        return np.ones(len(want), bool)
    starts = np.append(0, ends).tolist()
    return np.array([spelled[i:j] == w for i, j, w in zip(starts, starts[1:], want, strict=False)], bool)


def align(first: Side, second: Side, words: list[str]) -> Aligned:
    """Align words that a space goes before each; those that a side does not spell have no tokens."""
    want = [b" " + w.encode() for w in words]
    good, found = np.ones(len(words), bool), []
    for side in (first, second):
        ids = side.encode(words)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        good &= _spelled(side, flat, counts, want)
        found.append((flat, counts))
    a, b = (flat[np.repeat(good, counts)] for flat, counts in found)
    ends_a, ends_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    edges = np.append(0, np.cumsum(np.where(good, [len(w) for w in want], 0)))
    label = terminals(ends_a, ends_b)
    last = label[: len(a)] == np.arange(len(a))
    group = (np.cumsum(last) - last)[label]
    group_a, group_b = group[: len(a)], group[len(a) :]
    pieces = np.union1d(ends_a, ends_b)
    linked = (a[np.searchsorted(ends_a, pieces)] << 32) | b[np.searchsorted(ends_b, pieces)]
    n_a, n_b = (np.where(good, counts, 0) for _, counts in found)

    # Every token's place when groups follow each other, the first side's tokens before the second's.
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
    codes = np.empty(len(a) + len(b), np.int64)
    codes[place_a], codes[place_b] = a, b
    mark = np.full(len(codes), ord(","), np.int64)
    mark[place_a[np.append(group_a[1:] != group_a[:-1], True)[: len(a)]]] = ord("|")
    mark[place_b[np.append(group_b[1:] != group_b[:-1], True)[: len(b)]]] = ord(";")
    spelled = list(map(_spelling, ((codes << 8) | mark).tolist()))
    stops = np.append(0, np.cumsum(n_a + n_b)).tolist()
    groups = ["".join(spelled[i:j])[:-1] for i, j in zip(stops, stops[1:], strict=False)]
    figures = np.array([n_a, n_b, _per_word(ends_a[last], edges), _per_word(pieces, edges)])
    return Aligned(good, figures, groups, linked)


@functools.lru_cache(maxsize=1 << 16)
def _spelling(code: int) -> str:
    return f"{code >> 8}{chr(code & 255)}"


def cut(text: str) -> list[str]:
    """The words of a text behind a space; they and the spaces before them make up the text again."""
    head, *rest = _BORDER.split(" " + text)
    return [head[1:], *rest] if head else rest


def smallest(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def unpacked(packed: bytes, count: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // count}").astype(np.int64) if count else np.empty(0, np.int64)


def aligned_texts(known: Words, texts: list[str | None]) -> dict[str, np.ndarray | list | bytes]:
    """Figures of whole texts, and the links of the words that they consist of.

    Null and empty texts, and those with a word that a side does not spell byte
    for byte, have no words. ``words`` names the words by their places among the
    distinct ones, and ``links`` id pairs by theirs in ``pairs``.
    """
    if len(known.numbers) > _REMEMBERED or known.letters > _LETTERS_HELD:
        known.forget()
    runs, whole = [], not all(s.cuts for s in known.both)
    for text in texts:
        words = [] if not text else [text] if whole else cut(text)
        runs.append(np.fromiter(map(known.numbers.__getitem__, words), np.int64, len(words)))
    known.catch_up()
    runs = [run if known.good[run].all() else run[:0] for run in runs]
    run = np.concatenate([np.empty(0, np.int64), *runs])
    stops = np.append(0, np.cumsum([len(x) for x in runs], dtype=np.int64))
    distinct, places, uses = np.unique(run, return_inverse=True, return_counts=True)
    pairs, links = np.unique(known.links_of(distinct), return_inverse=True)
    word_links = known.n_links[distinct]
    totals = np.cumsum(known.figures[:, run], axis=1)
    totals = np.concatenate([np.zeros((4, 1), np.int64), totals], axis=1)
    n_a, n_b, n_groups, n_links = totals[:, stops[1:]] - totals[:, stops[:-1]]
    return {
        "n_words": np.diff(stops),
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": n_groups,
        "n_links": n_links,
        "groups": [
            hashlib.sha256(";".join(map(known.groups.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else ""
            for x in runs
        ],
        "n_distinct": len(distinct),
        "words": smallest(places),
        "word_links": smallest(word_links),
        "links": smallest(links),
        "pairs": pairs,
        "times": np.bincount(links, np.repeat(uses, word_links), len(pairs)).astype(np.int64),
    }


_LISTED = ("n_words", "n_a", "n_b", "n_groups", "n_links", "groups")
_PACKED = ("words", "word_links", "links")
_CHUNKS = (
    "chunk long, doc_ids array<long>, n_words array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups array<string>, n_distinct long, words binary, word_links binary, links binary, "
    "pairs array<long>, times array<long>"
)
_NAMES = [c.split()[0] for c in _CHUNKS.split(", ")]


def _aligned(first: str, second: str):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        known = Words(*sides(first, second))
        doc_ids, texts, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            found = aligned_texts(known, texts)
            columns = {"chunk": pa.array([base + count], pa.int64()), "doc_ids": _list(doc_ids, pa.int64())}
            columns |= {c: _list(found[c], pa.string() if c == "groups" else pa.int64()) for c in (*_LISTED, "pairs", "times")}
            columns |= {c: pa.array([found[c]], pa.binary()) for c in _PACKED}
            columns["n_distinct"] = pa.array([found["n_distinct"]], pa.int64())
            return pa.RecordBatch.from_arrays([columns[c] for c in _NAMES], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                doc_ids.append(doc_id)
                texts.append(text)
                # A row without text weighs something too, so that chunks of such rows end.
                size += 16 + len(text or "")
                if size >= CHUNK:
                    yield chunk()
                    doc_ids, texts, size, count = [], [], 0, count + 1
        if doc_ids:
            yield chunk()

    return aligned


def _list(values, kind: pa.DataType) -> pa.Array:
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _sums(chunks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums over their links."""
    row = {c: chunks.column(c).combine_chunks()[0] for c in chunks.column_names}
    listed = {c: row[c].values for c in ("doc_ids", *_LISTED)}
    n_words = listed["n_words"].to_numpy()
    words = unpacked(row["words"].as_py(), int(n_words.sum()))
    word_links = unpacked(row["word_links"].as_py(), row["n_distinct"].as_py())
    links = unpacked(row["links"].as_py(), int(word_links.sum()))
    place = counts.column("place").to_numpy()
    count, best = np.zeros((2, len(place)), np.int64)
    count[place] = counts.column("count").to_numpy()
    best[place] = counts.column("best").to_numpy(zero_copy_only=False)

    def added(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values, dtype=np.int64))
        stops = np.append(0, np.cumsum(sizes, dtype=np.int64))
        return total[stops[1:]] - total[stops[:-1]]

    def summed(values: np.ndarray) -> pa.Array:
        return pa.array(added(added(values[links], word_links)[words], n_words), pa.int64())

    return pa.table(
        [listed["doc_ids"], *(listed[c] for c in _LISTED[1:5]), summed(best), summed(count), listed["groups"]],
        names=[c.split()[0] for c in _RESULT.split(", ")],
    )


def align_documents(docs: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Aligned chunks of ``docs``, and (pair, count, best) of the corpus.

    ``pair`` is the first side's id times 2 to the 32 plus the second's; ``best``
    says that no pair with the same second id has a higher count.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = materialise(thin.mapInArrow(_aligned(first, second), _CHUNKS), "alignment-chunks")
    each = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.*")
    counts = materialise(each.groupBy("pairs").agg(F.sum("times").alias("count")), "alignment-counts")
    # One row for each id of the second vocabulary.
    highest = counts.groupBy(F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("highest"))
    told = counts.withColumn("b", F.col("pairs").bitwiseAND(0xFFFFFFFF)).join(F.broadcast(highest), "b")
    return chunks, told.select(F.col("pairs").alias("pair"), "count", (F.col("count") == F.col("highest")).alias("best"))


def token_alignment(docs: DataFrame, first: str, second: str) -> DataFrame:
    """How two tokenizer files split every whole text of ``docs`` (doc_id, text).

    ``first`` is a byte-level BPE file of the tokenizers library and gets the text
    behind a space; ``second`` a sentencepiece model, which adds the space itself.
    Special strings inside texts are plain text. Returns doc_id, n_a, n_b (tokens),
    n_groups (pieces between offsets where both sides end a token), n_links (pairs
    of tokens that overlap), n_best (links whose id pair is the most frequent of
    the corpus for its second id, ties included), count_sum (over links, the count
    of their id pair in the corpus) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and texts that a side does not spell byte for byte, have
    no tokens: zeros and an empty digest. A null doc_id stays null; repeated rows
    are all returned and all counted. A text of any length is aligned whole, in
    one task. An empty table gives no rows. Other columns are not read.
    """
    chunks, counts = align_documents(docs, first, second)
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").select(F.col("chunk").alias("part"), "place", "count", "best")
    return chunks.drop("pairs", "times").groupBy("chunk").cogroup(told.groupBy("part")).applyInArrow(_sums, _RESULT)
