"""Alignment of two tokenizers against sets of offsets and the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditloom.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def ranges(ids, pieces, want):
    spelled = [pieces(i) for i in ids]
    if b"".join(spelled) != want:
        return None
    out, at = [], 0
    for i, piece in zip(ids, spelled, strict=True):
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def direct(rows):
    """Every pair of overlapping ranges, one by one."""
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    letters = alignment.byte_letters()

    def piece_a(i):
        return bytes(letters[c] for c in first.id_to_token(i))

    def piece_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    aligned = []
    for doc_id, text in rows:
        want = b" " + (text or "").encode()
        a = ranges(first.encode(" " + (text or ""), add_special_tokens=False).ids, piece_a, want) if text else None
        b = ranges(second.encode(text), piece_b, want) if text else None
        if a is None or b is None:
            aligned.append((doc_id, [], [], [], ""))
            continue
        links = []
        start = 0
        for i, low, high in a:
            while b[start][2] <= low:
                start += 1
            at = start
            while at < len(b) and b[at][1] < high:
                links.append((i, b[at][0]))
                at += 1
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, left = [], [list(reversed(a)), list(reversed(b))]
        for cut in cuts:
            parts = [[], []]
            for part, side in zip(parts, left, strict=True):
                while side and side[-1][2] <= cut:
                    part.append(str(side.pop()[0]))
            groups.append("|".join(map(",".join, parts)))
        aligned.append((doc_id, a, b, links, ";".join(groups)))
    counts = Counter(x for *_, links, _ in aligned for x in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (
            doc_id,
            len(a),
            len(b),
            text.count(";") + bool(text),
            len(links),
            sum(counts[x] == highest[x[1]] for x in links),
            sum(counts[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        )
        for doc_id, a, b, links, text in aligned
    ]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def same(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert got(alignment.token_alignment(df, FIRST, SECOND)) == sorted(direct(rows), key=repr)


ODD = [
    "",
    None,
    " ",
    "a",
    "  two  spaces \n\n\t tabs ",
    "<|endoftext|> and <s> and </s> and <unk>",
    "▁ the mark itself",
    "日本語 und Straße, été \U0001f600\U0001f468‍\U0001f469",
    "é and é and ﬁ",
    "\x00 a null",
    "x" * 3000,
    "don't we'll 12345 3.14159 https://example.org/a?b=c",
]


def test_odd_texts(spark):
    same(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "a null identifier"), (3, "a"), (3, "a")])


def test_random_texts(spark):
    random.seed(7)
    words = ["token", "izer", "Überraschung", "naïve", "  ", "\n", "unbelievable", "GPT", "3", "—", "日", "'s", "."]
    rows = [(i, "".join(random.choice(words) + random.choice(["", " "]) for _ in range(random.randint(1, 60)))) for i in range(150)]
    same(spark, rows)


def test_chunks_do_not_matter(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("text").limit(60).collect()
    texts = [r["text"] for r in rows] + ODD
    known = alignment.Words(*alignment.sides(FIRST, SECOND))
    whole = alignment.aligned_texts(known, texts)
    parts = [alignment.aligned_texts(alignment.Words(*known.both), [t]) for t in texts]
    again = [alignment.aligned_texts(known, [t]) for t in texts]
    for name in ("groups", "n_links", "n_a", "n_words"):
        assert list(whole[name]) == [p[name][0] for p in parts] == [p[name][0] for p in again]
    assert whole["times"].sum() == whole["n_links"].sum()


def test_words_make_up_the_text():
    for text in [t for t in ODD if t] + ["a  b \u2581 c\u2581 d \u2581e\n f\t g  ", " x", "x "]:
        assert " " + " ".join(alignment.cut(text)) == " " + text
    assert all(s.cuts for s in alignment.sides(FIRST, SECOND))
    assert len(alignment.cut("plain words cut at spaces")) == 5


def test_without_cuts(spark):
    """Files whose tokens may span spaces are aligned text by text."""
    known = alignment.Words(*(s._replace(cuts=False) for s in alignment.sides(FIRST, SECOND)))
    cut = alignment.Words(*alignment.sides(FIRST, SECOND))
    texts = ["some text  with spaces", "and\n more", None]
    for name in ("groups", "n_links", "n_groups"):
        assert list(alignment.aligned_texts(known, texts)[name]) == list(alignment.aligned_texts(cut, texts)[name])


def test_packed_numbers():
    for values in ([], [0], [3, 255], [256, 0], [70000, 1]):
        values = np.array(values, np.int64)
        assert alignment.unpacked(alignment.smallest(values), len(values)).tolist() == values.tolist()


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t for t in ODD if t]
    known = alignment.Words(*alignment.sides(FIRST, SECOND))
    first = [alignment.aligned_texts(known, [t])["groups"] for t in texts]
    monkeypatch.setattr(alignment, "_REMEMBERED", 2)
    assert [alignment.aligned_texts(known, [t])["groups"] for t in texts] == first


def test_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    same(spark, rows)


def test_terminals_on_long_chains():
    """Ends that never meet before the last byte are one component."""
    n = 5000
    a, b = np.arange(2, 2 * n + 1, 2), np.append(np.arange(1, 2 * n, 2), 2 * n)
    assert (alignment.terminals(a, b) == n - 1).all()
    same_ends = np.arange(1, 50)
    assert alignment.terminals(same_ends, same_ends).tolist() == list(range(49)) * 2
    random.seed(1)
    for _ in range(50):
        a = np.unique(np.append(np.array(random.sample(range(1, 60), 20)), 60))
        b = np.unique(np.append(np.array(random.sample(range(1, 60), 25)), 60))
        ends = sorted(set(a.tolist()) & set(b.tolist()))
        label = alignment.terminals(a, b)
        want = [np.searchsorted(ends, x) for x in (*a.tolist(), *b.tolist())]
        assert [ends.index(a[i]) for i in label] == want


def test_edges(spark, edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    clash = {c: F.lit("own") for c in "n_a n_b n_groups n_links chunk pair pairs links count best".split()}
    assert got(alignment.token_alignment(edges.withColumns(clash), FIRST, SECOND)) == sorted(direct(rows), key=repr)
    assert alignment.token_alignment(nothing, FIRST, SECOND).count() == 0
