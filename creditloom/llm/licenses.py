"""License notices in texts: exact phrases, and longer notices with a few typing errors.

Texts are lower-cased (A-Z) and cut into words; the words, joined by single
spaces, are searched. A notice that may have ``k`` edits is split into ``k + 1``
seeds: by the pigeonhole principle one of them occurs unchanged in every match.
Places of seeds are found by plain search; only the words around a place are
given to the regex library, whose bounded-error matching verifies the whole notice
and gives its span. Exact places are taken first, then what is left between them is
searched with one edit, then with two and so on: every match has the fewest edits
possible, and none hides another that stands beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches

#: Phrases of the base scan and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Common notices, as words, and their labels.
NOTICES = {
    "licensed under the apache license": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "this program is free software you can redistribute it": "gpl",
    "under the terms of the general public license": "gpl",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "creative commons attribution": "cc",
    "this work is licensed under a creative commons": "cc",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "general public license": "gpl",
    "no part of this publication may be reproduced": "reserved",
    "reproduction without permission is prohibited": "reserved",
}
#: A notice may have one edit for so many letters; more would mistake names of three letters.
LETTERS_AN_EDIT = 16

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes(
    lower if (lower := i + 32 if 65 <= i <= 90 else i) in _WORD_BYTES else 32 for i in range(256)
)

SPAN = "struct<label:string,notice:string,first:long,last:long,edits:int>"


def words_of(text: str | None) -> list[bytes]:
    """Words of digits, letters and everything beyond ASCII, in lower case."""
    return (text or "").encode().translate(_TO_WORDS).split()


@dataclass(frozen=True)
class _Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[int, bytes], ...]
    #: One for each number of edits from 0 on.
    patterns: tuple[regex.Pattern, ...]


@lru_cache(maxsize=4)
def _prepared(notices: tuple[tuple[str, str], ...], letters_an_edit: int) -> list[_Notice]:
    found = []
    for text, label in notices:
        raw = text.encode()
        edits = max(1, len(raw) // letters_an_edit)
        cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
        seeds = tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        patterns = tuple(regex.compile(f"(?:{regex.escape(text)}){{e<={n}}}") for n in range(edits + 1))
        found.append(_Notice(text, label, edits, seeds, patterns))
    return found


def _windows(line: bytes, notice: _Notice) -> list[tuple[int, int]]:
    """Whole words around every place of a seed, overlapping ones merged."""
    spans = []
    length = len(notice.text.encode())
    for offset, seed in notice.seeds:
        at = line.find(seed)
        while at >= 0:
            # A letter beyond ASCII takes up to four bytes, so edits reach four times as far.
            low = max(0, at - offset - 4 * notice.edits)
            high = min(len(line), at - offset + length + 4 * notice.edits)
            spans.append((line.rfind(b" ", 0, low) + 1, end if (end := line.find(b" ", high)) >= 0 else len(line)))
            at = line.find(seed, at + 1)
    merged: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _matches(window: str, notice: _Notice) -> Iterator[tuple[regex.Match, int]]:
    """Matches that do not overlap, those of fewest edits first, and their edits."""
    gaps = [(0, len(window))]
    for edits, pattern in enumerate(notice.patterns):
        left = []
        for low, high in gaps:
            for match in pattern.finditer(window, low, high):
                yield match, edits
                left.append((low, match.start()))
                low = match.end()
            left.append((low, high))
        # A match is no shorter than the notice less its edits.
        gaps = [(low, high) for low, high in left if high - low >= len(notice.text) - notice.edits]


def notice_spans(words: list[bytes], notices: list[_Notice]) -> list[dict]:
    """Verified notices of a text: label, notice, first and last word, and edits."""
    line = b" ".join(words)
    found = []
    for notice in notices:
        for low, high in _windows(line, notice):
            window = line[low:high].decode()
            for match, edits in _matches(window, notice):
                start = low + len(window[: match.start()].encode())
                inside = match.group().strip()
                first = line.count(b" ", 0, start + (match.group()[:1] == " "))
                found.append(
                    {
                        "label": notice.label,
                        "notice": notice.text,
                        "first": first,
                        "last": first + inside.count(" "),
                        "edits": edits,
                    }
                )
    return sorted(found, key=lambda s: (s["first"], s["last"], s["notice"]))


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """First words of every exact place of each phrase."""
    line = b" " + b" ".join(words) + b" "
    places = {}
    for phrase in phrases:
        needle, starts, before, counted = b" " + phrase.encode() + b" ", [], 0, 0
        at = line.find(needle)
        while at >= 0:
            counted += line.count(b" ", before, at)
            before = at
            starts.append(counted)
            at = line.find(needle, at + 1)
        places[phrase] = starts
    return places


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    f"score double, spans array<{SPAN}>"
)
_SPAN_TYPE = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("notice", pa.string()),
            ("first", pa.int64()),
            ("last", pa.int64()),
            ("edits", pa.int32()),
        ]
    )
)


def _scan(phrases: dict[str, str], notices: tuple[tuple[str, str], ...], letters_an_edit: int):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _prepared(notices, letters_an_edit)
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                words = words_of(x.as_py())
                places = phrase_places(words, phrases)
                starts = [s for found in places.values() for s in found]
                base = {phrases[p] for p, found in places.items() if found}
                spans = notice_spans(words, prepared)
                exactness = [1 - s["edits"] / len(s["notice"]) for s in spans]
                rows.append(
                    (
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {s["label"] for s in spans})),
                        1.0 if base else max(exactness, default=0.0),
                        spans,
                    )
                )
            types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), _SPAN_TYPE)
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=[
                    "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans",
                ],
            )

    return scanned


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    letters_an_edit: int = LETTERS_AN_EDIT,
) -> DataFrame:
    """License phrases and notices in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base (places of exact phrases, overlapping ones
    included), first_word and last_word (smallest and largest first word of such a
    place, else null), base_labels, labels (with those of notices that have at
    most one edit for ``letters_an_edit`` letters; both distinct, sorted and joined
    by commas), score (1 for an exact phrase, else the share of unchanged letters
    of the best notice, else 0) and spans (label, notice, first and last word,
    edits). A null or empty text has no words and score 0; a null doc_id stays
    null; repeated rows are all scanned. An empty table gives no rows. Other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = tuple((NOTICES if notices is None else notices).items())
    return thin.mapInArrow(_scan(PHRASES if phrases is None else phrases, listed, letters_an_edit), _SCHEMA)
