"""Fingerprints of the phrases that a compressor finds in a text.

A text is parsed into Lempel-Ziv phrases: each is the longest phrase seen before
and one character more. Texts that compress each other well share many
phrases. The fingerprint is a one-permutation minimum hash of the phrase set: the
hash of a phrase names one of ``REGISTERS`` ranges and the smallest hash of each
range is kept, in 16 bits. The share of equal registers among those that either
text fills estimates the similarity of the two phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.session import materialise

REGISTERS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_EDGES = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parse:
    """A parse that can be continued, and branched before going on."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.lengths: list[int] = []
        self.open = ""

    def branch(self) -> Parse:
        other = Parse()
        other.seen, other.lengths, other.open = self.seen.copy(), self.lengths.copy(), self.open
        return other

    def read(self, text: str) -> Parse:
        seen, add, cut, phrase = self.seen, self.seen.add, self.lengths.append, self.open
        for char in text:
            phrase += char
            if phrase not in seen:
                add(phrase)
                cut(len(phrase))
                phrase = ""
        self.open = phrase
        return self


def phrase_hashes(text: str, lengths: list[int]) -> np.ndarray:
    """Sorted hashes of the phrases, which are consecutive parts of the text.

    Letters times powers of a number, added up, give the hash of any part from
    two running sums.
    """
    if not lengths:
        return np.empty(0, np.uint64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer(text[: int(ends[-1])].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    powers = np.cumprod(np.full(len(codes), _BASE, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes + np.uint64(1)) * powers, dtype=np.uint64)])
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(codes), _INVERSE, np.uint64), dtype=np.uint64)])
    return np.sort(_mixed((sums[ends] - sums[starts]) * back[starts] + np.array(lengths, np.uint64)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """A register for each range of hashes: 0 if empty, else from its smallest hash."""
    if len(hashes) == 0:
        return np.zeros(REGISTERS, np.uint16)
    first = np.searchsorted(hashes, _EDGES)
    empty = first == np.append(first[1:], len(hashes))
    least = hashes[np.minimum(first, len(hashes) - 1)]
    return np.where(empty, 0, 1 + (least >> np.uint64(16)) % np.uint64(65535)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal registers by registers that either fills; two empty texts are alike."""
    filled = (a > 0) | (b > 0)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def written(registers: np.ndarray) -> str:
    """The signature as four hexadecimal digits a register."""
    return registers.astype(">u2").tobytes().hex()


class _Document:
    """A document whose next one is still to come."""

    def __init__(self, doc_id: int | None, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 2
        start = Parse().read(text[: self.cut])
        self._rest = start.branch()
        whole = start.read(text[self.cut :])
        self.registers = signature(phrase_hashes(text, whole.lengths))

    def row(self, following: _Document) -> tuple:
        edited = self.text[: self.cut] + following.text[: len(self.text) // 2]
        parsed = self._rest.read(edited[self.cut :])
        registers = signature(phrase_hashes(edited, parsed.lengths))
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            written(self.registers),
            written(registers),
            likeness(self.registers, registers),
            likeness(self.registers, following.registers),
        )


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_EDGE = "part int, role string, text string"


def _batch(rows: list[tuple], part: int | None = None, role: str | None = None, texts: list | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
    arrays += [pa.array([part] * len(rows), pa.int32()), pa.array([role] * len(rows), pa.string())]
    arrays.append(pa.array(texts if texts is not None else [None] * len(rows), pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=[*_NAMES, "part", "role", "text"])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish every document of a sorted range but the last; pass on both ends' texts."""
    held, part = None, None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            now = _Document(doc_id, text.as_py())
            if held is None:
                part = batch.column("part")[0].as_py()
                yield _batch([(doc_id, *[None] * 6)], part, "first", [now.text])
            else:
                rows.append(held.row(now))
            held = now
        yield _batch(rows, part, "done")
    if held is not None:
        yield _batch([(held.doc_id, *[None] * 6)], part, "last", [held.text])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish the last documents of the ranges."""
    for batch in batches:
        rows = [
            _Document(doc_id, text).row(_Document(None, following))
            for doc_id, text, following in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True
            )
        ]
        yield _batch(rows).select(_NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text of ``docs`` (doc_id, text) and an edited version.

    The edited text's last half (rounded down) is replaced by as many first
    characters, or all, of the next document by doc_id; the first follows the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (likeness of the fingerprint to the edited text's
    and to the next document's).

    A null text is empty; empty texts are alike and unlike all others. Null
    doc_ids come last; rows with one doc_id follow each other by a hash of their
    text. A single row is its own next. An empty table gives no rows. Other
    columns are not read.

    Texts are shuffled once, by ranges of doc_id. A range finishes all its
    documents but the last, which needs the first of the next range: one row for
    each range.
    """
    small_batches(docs.sparkSession)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())
    found = materialise(ranged.mapInArrow(_along, f"{_RESULT}, {_EDGE}"), "fingerprints")
    edges = found.filter("role = 'first'")
    everything = Window.partitionBy(F.lit(0))
    following = F.coalesce(F.lead("part").over(everything.orderBy("part")), F.min("part").over(everything))
    firsts = edges.select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = found.filter("role = 'last'").select("doc_id", "text", "part")
    ends = lasts.join(edges.select("part", following.alias("next")), "part").join(firsts, "next")
    return found.filter("role = 'done'").select(*_NAMES).union(
        ends.select("doc_id", "text", "following").mapInArrow(_across, _RESULT)
    )
