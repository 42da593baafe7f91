"""Token counts with a shortcut for whole-word tokens.

Before the job, every vocabulary string that ends a word is tried alone: if it
stays one pre-token and encodes to itself, a pre-token equal to it is one token.
Inside tasks such pre-tokens are counted by a look-up; only the others are merged,
once for each spelling that a worker remembers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.llm.wordbpe import WordBpe, word_bpe

#: Merged spellings that a worker remembers.
_REMEMBERED = 1 << 18


@functools.lru_cache(maxsize=2)
def proven_words(path: str) -> tuple[str, ...]:
    """Vocabulary strings that alone encode as the one token they name.

    At most as many as the vocabulary has.
    """
    bpe = word_bpe(path)
    letters = {bpe.spelled(chr(b)): b for b in range(128)}
    letters |= {c: b for b in range(128, 256) for c in _byte_letter(bpe, b)}
    proven = []
    for token, number in bpe.library.get_vocab(with_added_tokens=False).items():
        if not (bpe.suffix and token.endswith(bpe.suffix)):
            continue
        stem = token[: -len(bpe.suffix)]
        try:
            word = bytes(letters[c] for c in stem).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        words, spelled = bpe.words(word)
        if (words != [word] and not (spelled and words == [stem])) or bpe.sections(word) != [(word, False)]:
            continue
        if [t.id for t in bpe.outer.tokenize(stem)] == [number]:
            proven.append(word)
    return tuple(proven)


def _byte_letter(bpe: WordBpe, byte: int) -> str:
    """The letter that spells a byte above ASCII, found in a character that contains it."""
    for char in (chr(byte), chr(0x100 + byte), chr((byte & 0x1F) << 6 | 0x80), chr((byte & 0x0F) << 12 | 0x800)):
        try:
            raw = char.encode()
        except UnicodeEncodeError:
            continue
        if byte in raw:
            return bpe.spelled(char)[raw.index(byte)]
    return ""


class _Counts(dict):
    """Tokens of a pre-token: 1 for the proven, else by merging."""

    def __init__(self, bpe: WordBpe, proven: tuple[str, ...]) -> None:
        super().__init__(dict.fromkeys(proven, 1))
        self._bpe, self._proven = bpe, proven

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED + len(self._proven):
            self.clear()
            self.update(dict.fromkeys(self._proven, 1))
        value = self[word] = len(self._bpe.outer.tokenize(self._bpe.spelled(word)))
        return value


def count_tokens(text: str | None, bpe: WordBpe, counts: _Counts) -> int:
    """Tokens of a whole text; a special string counts as its one token."""
    total = 0
    for part, special in bpe.sections(text):
        if special:
            total += 1
            continue
        words, spelled = bpe.words(part)
        if spelled:
            total += sum(len(bpe.outer.tokenize(w)) for w in words)
        else:
            total += sum(map(counts.__getitem__, words))
    return total


def _counter(path: str, proven) -> object:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        counts = _Counts(bpe, proven.value)
        for batch in batches:
            tokens = [count_tokens(x.as_py(), bpe, counts) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return counted


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text of ``docs`` (doc_id, text) by the tokenizer file ``path``.

    Returns doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than
    ``limit``). Begin and end tokens are not added; special strings inside a
    text are the special tokens, as the library takes them. A null or empty text
    has no tokens; a null doc_id stays null; repeated rows are all counted. An
    empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    proven = docs.sparkSession.sparkContext.broadcast(proven_words(path))
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").cast("string").alias("text"),
    )
    counted = thin.mapInArrow(_counter(path, proven), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
