"""License scan against plain search and against fuzzy matching of the whole text."""

import re

import pytest
import regex

from creditloom.llm import licenses


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    words = words_of(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_base(request, source):
    df = request.getfixturevalue(source)
    want = [(r["doc_id"], *base(r["text"])) for r in df.select("doc_id", "text").collect()]
    rows = licenses.scan_licenses(df).collect()
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("text", "label", "first", "last", "edits"),
    [
        ("x, Licensed under the Apache License, Version 2.0", "apache", 1, 5, 0),
        ("LICENCED under teh-- nothing. Licenced under the apache license", "apache", 4, 8, 1),
        ("we say: permision is hereby granted, free of charge to any person obtaning a copy", "mit", 2, 14, 2),
        ("été straße redistribution and use in source and binery forms", "bsd", 2, 9, 1),
        ("All rights resrved.", "reserved", 0, 2, 1),
        ("gnu affero general public licence", "agpl", 0, 4, 1),
    ],
)
def test_notices_with_errors(spark, text, label, first, last, edits):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licenses.scan_licenses(df).first()
    assert label in row["labels"].split(",")
    spans = [s for s in row["spans"] if s["label"] == label]
    assert (spans[0]["first"], spans[0]["last"], spans[0]["edits"]) == (first, last, edits)


def test_seeds_lose_no_match():
    """Windows around seeds find a notice exactly where a search of the whole line does."""
    import random

    draw = random.Random(5)
    notice = "redistribution and use in source and binary forms"
    prepared = licenses._prepared(((notice, "bsd"),), licenses.LETTERS_AN_EDIT)
    whole = regex.compile(f"(?b)(?:{notice}){{e<={prepared[0].edits}}}")
    hits = 0
    for _ in range(300):
        changed = list(notice)
        for _ in range(draw.randint(0, 5)):
            at = draw.randrange(len(changed))
            changed[at : at + 1] = draw.choice([[], [draw.choice("abcé")], [changed[at], "x"]])
        words = licenses.words_of(f"before it {''.join(changed)} after it")
        found = licenses.notice_spans(words, prepared)
        assert bool(found) == bool(whole.search(b" ".join(words).decode()))
        hits += bool(found)
    assert 50 < hits < 300


def best_first(pattern, line, low, high):
    """The best match of a stretch, and those of the stretches on both sides of it."""
    match = pattern.search(line, low, high)
    if match is None:
        return []
    before, after = line[: match.start()], match.group()
    first = before.count(" ") + after.startswith(" ")
    own = (first, first + after.strip().count(" "), sum(match.fuzzy_counts))
    return [*best_first(pattern, line, low, match.start()), own, *best_first(pattern, line, match.end(), high)]


@pytest.mark.parametrize(
    "notice",
    ["creative commons attribution", "all rights reserved", "redistribution and use in source and binary forms"],
)
def test_notices_close_by_are_all_found(notice):
    """Misspelt notices before, between and after exact ones, against searches of the whole line."""
    import random

    draw = random.Random(9)
    prepared = licenses._prepared(((notice, "x"),), licenses.LETTERS_AN_EDIT)
    whole = regex.compile(f"(?b)(?:{notice}){{e<={prepared[0].edits}}}")
    cases = [" ".join(["creative comons attribution"] * 3 + ["creative commons attribution"])]
    for _ in range(150):
        parts = []
        for _ in range(draw.randint(1, 6)):
            changed = list(notice)
            for _ in range(draw.randint(0, prepared[0].edits + 1)):
                at = draw.randrange(len(changed))
                changed[at : at + 1] = draw.choice([[], [draw.choice("abcé")], [changed[at], "x"]])
            parts.append("".join(changed))
        cases.append("before it " + draw.choice([" ", " and then "]).join(parts) + " after it")
    most = 0
    for text in cases:
        words = licenses.words_of(text)
        line = b" ".join(words).decode()
        got = [(s["first"], s["last"], s["edits"]) for s in licenses.notice_spans(words, prepared)]
        assert got == best_first(whole, line, 0, len(line)), text
        most = max(most, len(got))
    assert most > 3


def test_other_lists_and_empty_table(edges, nothing):
    rows = licenses.scan_licenses(edges, {"same row": "own"}, {}).collect()
    assert {r["labels"] for r in rows} == {"", "own"}
    assert licenses.scan_licenses(nothing).count() == 0
