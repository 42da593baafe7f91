"""Token counts and encodings against the tokenizers library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditloom.llm import bpe, token_counts, wordbpe


@pytest.fixture(scope="module")
def library(vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_counts(request, source, vocabulary, library):
    df = request.getfixturevalue(source)
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)
        for r in df.select("doc_id", "text").collect()
        for n in [len(encoded(library, r["text"]))]
    ]
    got = [tuple(r) for r in token_counts.token_counts(df, vocabulary).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("source", "longest", "piece"), [("documents", 1 << 14, 1 << 12), ("edges", 300, 64), ("documents", 9, 2)])
def test_round_trip(request, source, longest, piece, vocabulary, library):
    df = request.getfixturevalue(source)
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = encoded(library, r["text"])
        want.append((r["doc_id"], len(ids), bpe.packed(ids), library.decode(ids, skip_special_tokens=False)))
    got = [
        (r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"])
        for r in bpe.encode(df, vocabulary, longest, piece).collect()
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_alphabet_of_the_fast_way(vocabulary, library):
    """Every letter of the own splitting, in several surroundings, as the library splits it."""
    tokenizer = wordbpe.word_bpe(vocabulary)
    for c in wordbpe._ALPHABET:
        for text in (f"a{c}b", f"1{c}{c}2 {c}", f"'{c}s.{c}'ll {c.upper()}"):
            words, spelled = tokenizer.words(text)
            normal = library.normalizer.normalize_str(text)
            pieces = [p for p, _ in library.pre_tokenizer.pre_tokenize_str(normal)]
            assert (words if spelled else [tokenizer.spelled(w) for w in words]) == pieces


def test_proven_words_are_one_token(vocabulary, library):
    proven = token_counts.proven_words(vocabulary)
    assert len(proven) > 10_000
    for word in random.Random(0).sample(proven, 2000):
        assert len(encoded(library, word)) == 1


@settings(max_examples=300, deadline=None)
@given(
    st.text(st.sampled_from("abehintorséß"), min_size=1, max_size=200) | st.text(st.sampled_from("a!"), min_size=1, max_size=60),
    st.integers(1, 20),
    st.integers(1, 4),
)
def test_joined_halves_equal_the_whole(text, piece, window):
    import public_tokenizers

    tokenizer = wordbpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    spelled = tokenizer.spelled(text)
    pieces = bpe.halves(spelled, piece)
    tokens = [bpe.encode_piece(tokenizer, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    while len(tokens) > 1:
        tokens = [
            bpe.join(tokenizer, *tokens[i : i + 2], i + 2 == len(tokens), window) if i + 1 < len(tokens) else tokens[i]
            for i in range(0, len(tokens), 2)
        ]
    assert tokens[0] == bpe.encode_piece(tokenizer, spelled, True)


def test_runs_just_under_the_limit_and_shuffled_rows(spark, vocabulary, library):
    """Long runs on both sides of the limit, from a shuffled table: pieces of different rows are never mixed."""
    draw = random.Random(6)
    rows = [(i % 5, "".join(draw.choices("abcdé0+", k=n)) + " end") for i, n in enumerate([99, 100, 101, 299, 300, 301, 900, 2500] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "text")
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in bpe.encode(df, vocabulary, 300, 64).collect())
    assert got == sorted((i, bpe.packed(encoded(library, t))) for i, t in rows)


def test_empty_tables(nothing, vocabulary):
    assert token_counts.token_counts(nothing, vocabulary).count() == 0
    assert bpe.encode(nothing, vocabulary).count() == 0


def test_packed_numbers():
    assert bpe.packed([1, 258]) == b"\x01\0\0\0\x02\x01\0\0"
    assert hashlib.sha256(bpe.packed([])).hexdigest() == hashlib.sha256(b"").hexdigest()
