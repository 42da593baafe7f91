"""BPE encoding and decoding, with long unsplit text encoded in parallel pieces.

A text is split into pre-tokens. Most are short and are merged as they are. One
of more than ``longest`` letters (no white space, no change between letters and
signs) is halved until its pieces are short, the pieces are encoded in different
tasks, and neighbours are joined pairwise up the tree of halves. A join encodes
a window around the cut anew: some tokens of the left side's end and of the
right side's start. If the window's outermost tokens come out as they were, both
sides agree with it and the rest stands; if not, the window doubles, at most to
both whole sides.

Why agreement is enough: a sequence of tokens is what the merges make of its text
exactly if that holds for every two neighbours. Pairs inside the sides and inside
the window hold because they are encodings; the pairs at the window's edges are
pairs that a side had already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.llm.wordbpe import WordBpe, word_bpe
from creditloom.session import materialise

#: Letters of a pre-token from which it is encoded in pieces, and letters of a piece.
LONGEST, PIECE = 1 << 14, 1 << 12
#: Tokens on each side of a cut that are encoded anew at first.
WINDOW = 8
_REMEMBERED = 1 << 18

_OUT = "doc_id long, n_tokens long, ids binary, decoded string"


def packed(ids: list[int]) -> bytes:
    """Token numbers as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


class _Encodings(dict):
    """Packed tokens of a pre-token."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self._bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = packed([t.id for t in self._bpe.outer.tokenize(self._bpe.spelled(word))])
        return value


def encode_piece(bpe: WordBpe, spelled: str, ends: bool) -> list[int]:
    """Tokens of a piece of a pre-token; only the last piece ends the word."""
    return [t.id for t in (bpe.outer if ends else bpe.inner).tokenize(spelled)]


def _spelling(bpe: WordBpe, ids: list[int]) -> str:
    """The letters of tokens, without the mark of the word's end."""
    text = "".join(bpe.names[i] for i in ids)
    return text[: -len(bpe.suffix)] if bpe.suffix and text.endswith(bpe.suffix) else text


def join(bpe: WordBpe, left: list[int], right: list[int], ends: bool, window: int = WINDOW) -> list[int]:
    """The tokens of two neighbouring pieces; ``ends``: the right one ends the word."""
    if not left or not right:
        return left or right
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        middle = encode_piece(bpe, _spelling(bpe, left[a:] + right[:b]), ends and b == len(right))
        if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
            return left[:a] + middle + right[b:]
        window *= 2


def join_all(bpe: WordBpe, pieces: list[list[int]], ends: bool) -> list[int]:
    """Join neighbours up the tree of halves."""
    while len(pieces) > 1:
        pairs = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
        pieces = [
            join(bpe, p[0], p[1], ends and i == len(pairs) - 1) if len(p) == 2 else p[0] for i, p in enumerate(pairs)
        ]
    return pieces[0] if pieces else []


def halves(spelled: str, piece: int) -> list[str]:
    """The pieces of repeated halving, all of them equally deep."""
    count = 1
    while len(spelled) > count * piece:
        count *= 2
    edges = [len(spelled) * i // count for i in range(count + 1)]
    return [spelled[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def decode(bpe: WordBpe, ids: bytes) -> str:
    """The library's decoding with special tokens: without a decoder, names between spaces."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    if bpe.library.decoder is None:
        return " ".join(map(bpe.names.__getitem__, numbers))
    return bpe.library.decode(numbers, skip_special_tokens=False)


def _result(doc_ids: pa.Array, ids: list[bytes], bpe: WordBpe) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array(ids, pa.binary()),
            pa.array([decode(bpe, x) for x in ids], pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids", "decoded"],
    )


def _encode_whole(path: str):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        known = _Encodings(bpe)
        for batch in batches:
            found = []
            for x in batch.column("text"):
                parts = []
                for part, special in bpe.sections(x.as_py()):
                    if special:
                        parts.append(packed([bpe.special[part]]))
                        continue
                    words, spelled = bpe.words(part)
                    if spelled:
                        parts += [packed([t.id for t in bpe.outer.tokenize(w)]) for w in words]
                    else:
                        parts += map(known.__getitem__, words)
                found.append(b"".join(parts))
            yield _result(batch.column("doc_id"), found, bpe)

    return encoded


def _cut(path: str, longest: int, piece: int):
    """Texts to rows: finished tokens between long pre-tokens, and pieces of those."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        known = _Encodings(bpe)
        for batch in batches:
            for row, doc_id, x in zip(batch.column("row"), batch.column("doc_id"), batch.column("text"), strict=True):
                out, done, run = [], [], 0
                for part, special in bpe.sections(x.as_py()):
                    if special:
                        done.append(packed([bpe.special[part]]))
                        continue
                    words, spelled = bpe.words(part)
                    for word in words:
                        if len(word) <= longest:
                            done.append(packed(encode_piece(bpe, word, True)) if spelled else known[word])
                            continue
                        out.append((run, False, None, b"".join(done)))
                        cuts = halves(word if spelled else bpe.spelled(word), piece)
                        out += [(run + 1, i == len(cuts) - 1, c, None) for i, c in enumerate(cuts)]
                        done, run = [], run + 2
                out.append((run, False, None, b"".join(done)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row.as_py()] * len(out), pa.int64()),
                        pa.array([doc_id.as_py()] * len(out), pa.int64()),
                        pa.array(range(len(out)), pa.int64()),
                        *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CUT_TYPES, strict=True)),
                    ],
                    names=["row", "doc_id", "place", "run", "ends", "piece", "ids"],
                )

    return cut


_CUT_TYPES = (pa.int64(), pa.bool_(), pa.string(), pa.binary())
_CUT = "row long, doc_id long, place long, run long, ends boolean, piece string, ids binary"


def _encode_pieces(path: str):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            ids = [
                done if piece is None else packed(encode_piece(bpe, piece, ends))
                for piece, ends, done in zip(
                    *(batch.column(c).to_pylist() for c in ("piece", "ends", "ids")), strict=True
                )
            ]
            kept = [batch.column(c) for c in ("row", "doc_id", "place", "run", "ends")]
            mark = pa.array([p.is_valid for p in batch.column("piece")], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*kept, mark, pa.array(ids, pa.binary())],
                names=["row", "doc_id", "place", "run", "ends", "cut", "ids"],
            )

    return encoded


def _joined(path: str):
    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        """All pieces of one document; together they are no longer than its row."""
        bpe = word_bpe(path)
        parts = []
        for _, run in rows.sort_values("place").groupby("run", sort=True):
            if run["cut"].iloc[0]:
                pieces = [np.frombuffer(x, "<u4").tolist() for x in run["ids"]]
                parts.append(packed(join_all(bpe, pieces, True)))
            else:
                parts += list(run["ids"])
        ids = b"".join(parts)
        return pd.DataFrame(
            {"doc_id": rows["doc_id"].iloc[:1].astype("Int64"), "n_tokens": [len(ids) // 4], "ids": [ids], "decoded": [decode(bpe, ids)]}
        )

    return joined


def encode(docs: DataFrame, path: str, longest: int = LONGEST, piece: int = PIECE) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) by the tokenizer file ``path`` and decode it.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and
    decoded. The result equals the library's, without added begin and end tokens
    and with special strings inside texts taken as special tokens. Only texts
    with a run of ``longest`` characters without white space are shuffled, in
    pieces. A null or empty text has no tokens and decodes to an empty text; a
    null doc_id stays null; repeated rows are all encoded. An empty table gives
    no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Composing characters may shorten a text but never makes a run longer than three times.
    # A run is looked at from its start only, so that a text costs one pass whatever its runs are.
    unsplit = F.coalesce(F.col("text").rlike(rf"(?<!\S)\S{{{max(1, longest // 3)}}}"), F.lit(False))
    whole = thin.filter(~unsplit).mapInArrow(_encode_whole(path), _OUT)
    # Numbered and written once: a recomputed task must not number the rows anew.
    numbered = materialise(thin.filter(unsplit).withColumn("row", F.monotonically_increasing_id()), "bpe-unsplit")
    pieces = (
        numbered.mapInArrow(_cut(path, longest, piece), _CUT)
        .repartition("row", "place")
        .mapInArrow(
            _encode_pieces(path),
            "row long, doc_id long, place long, run long, ends boolean, cut boolean, ids binary",
        )
    )
    return whole.union(pieces.groupBy("row").applyInPandas(_joined(path), _OUT))
