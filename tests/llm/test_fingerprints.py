"""Phrase fingerprints against a direct parse."""

import hashlib

import numpy as np
import pytest

from creditloom.llm import fingerprints as fp


def phrases(text):
    seen, start = [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.append(text[start:end])
            start = end
    return seen


def test_phrases_are_those_of_the_parse():
    for text in ("", "a", "aaaaaaaaab", "abracadabra abracadabra", "日本日本日本é", "x" * 300):
        parsed = fp.Parse().read(text)
        ends = np.cumsum(parsed.lengths)
        assert [text[e - n : e] for n, e in zip(parsed.lengths, ends, strict=True)] == phrases(text)
        half = fp.Parse().read(text[: len(text) // 2])
        branch = half.branch().read(text[len(text) // 2 :])
        assert branch.lengths == parsed.lengths and branch.open == parsed.open


def test_a_phrase_hashes_alike_wherever_it_stands():
    a = fp.phrase_hashes("abcdefgh", [1, 2, 5])
    b = fp.phrase_hashes("defghbca", [5, 2, 1])
    assert sorted(a) == sorted(b) and len(set(a)) == 3


def test_likeness_estimates_shared_phrases():
    draw = np.random.default_rng(0)
    left = np.unique(draw.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    for share in (0.2, 0.5, 0.9):
        n = int(len(left) * share)
        other = np.unique(np.concatenate([left[draw.permutation(len(left))[:n]], draw.integers(0, 2**63, 4000 - n).astype(np.uint64) * np.uint64(2)]))
        exact = n / (len(left) + len(other) - n)
        assert abs(fp.likeness(fp.signature(left), fp.signature(other)) - exact) < 0.2


@pytest.mark.parametrize(("source", "parts"), [("documents", 1), ("documents", 5), ("edges", 4)])
def test_rows(request, spark, source, parts):
    df = request.getfixturevalue(source)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.fingerprints(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows if i is not None}
    ids = sorted(texts)
    seen = {}
    for n, i in enumerate(ids[:-1] if source == "edges" else ids):
        text, following = texts[i], texts[ids[(n + 1) % len(ids)]]
        if i == 11:  # twice in the edge table, so one of them follows itself
            continue
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = by_id[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        registers = [fp.signature(fp.phrase_hashes(t, fp.Parse().read(t).lengths)) for t in (text, edited, following)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.written(registers[0]), fp.written(registers[1]))
        assert (r["near_edited"], r["near_next"]) == tuple(fp.likeness(registers[0], x) for x in registers[1:])
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_one_row_and_none(spark, nothing):
    row = fp.fingerprints(spark.createDataFrame([(1, "alone alone")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0
    assert row["edited_sha256"] == hashlib.sha256(b"alone alone"[:6] + b"alone").hexdigest()
    assert fp.fingerprints(nothing).count() == 0
