"""Spelling variants against a plain dictionary of all edits."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def direct(rows, shortest=variants.SHORTEST, rarest=variants.RAREST, times=variants.TIMES):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= rarest}
    # Words one edit apart share a deletion of one letter, or one is a deletion of the other.
    shapes = defaultdict(set)
    for w in words:
        for shape in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shapes[shape].add(w)
    links = defaultdict(set)
    for some in shapes.values():
        for w in some:
            links[w] |= {x for x in some if x not in links[w] and near(w, x)}
    forms = {}
    for w in words:
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= times * words[w]:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(links[w]), words.get(forms.get(w))))
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def family_texts(seed, documents=300):
    """Few frequent words, and rare ones an edit or two away from them and from each other."""
    random.seed(seed)
    base = ["spelling", "variants", "géographie", "Grouping", "frequency", "überholt", "aaaaaaaa", "abababab"]
    letters = "abcdeéüxyz"

    def edited(word):
        at = random.randrange(len(word))
        return random.choice(
            [word[:at] + word[at + 1 :], word[:at] + random.choice(letters) + word[at:], word[:at] + random.choice(letters) + word[at + 1 :]]
        )

    rare = [edited(w) for w in base for _ in range(12)]
    rare += [edited(w) for w in rare]
    return [
        (i, " ".join(random.choices(base, k=30) + random.choices(rare, k=8)) + random.choice(["", ", 2x-y_z\n"]))
        for i in range(documents)
    ]


@pytest.mark.parametrize("subtree", [variants.SUBTREE, 5])
def test_families(spark, subtree):
    rows = family_texts(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = direct(rows)
    assert any(f for _, f, *_ in want) and any(r != f and f for _, f, r, *_ in want)
    assert got(variants.spelling_variants(df, subtree=subtree)) == want


def test_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(variants.spelling_variants(docs)) == direct(rows)


def test_search_finds_all_near_words():
    random.seed(2)
    words = sorted({"".join(random.choices("abck", k=random.randint(1, 6))) for _ in range(600)})
    asking = sorted({"".join(random.choices("abck", k=random.randint(1, 7))) for _ in range(200)})
    found = {(int(a), int(b)) for some in variants.Trie(words).search(asking) for a, b in zip(*some, strict=True)}
    assert found == {(i, j) for i, a in enumerate(asking) for j, b in enumerate(words) if near(a, b)}


@pytest.mark.parametrize("depth", range(variants.GROUPS + 1))
def test_budget_reaches_every_near_word(depth):
    random.seed(depth)
    for _ in range(300):
        a = "".join(random.choices("abcdefghijklmnopé", k=random.randint(2, 9)))
        at = random.randrange(len(a))
        for b in (a[:at] + a[at + 1 :], a[:at] + "z" + a[at:], a[:at] + "q" + a[at + 1 :]):
            x, y = variants.vectors_of([a, b]).tolist()
            assert (y[: depth + 1] in variants.reachable(x, depth)) + (x[: depth + 1] in variants.reachable(y, depth)) == (
                2 if x[: depth + 1] == y[: depth + 1] else 1
            )
    some = variants.reachable(x, depth)
    assert some[0] == x[: depth + 1] and len(some) == len({tuple(s) for s in some}) <= 2 + 2 * depth + depth * (depth - 1) / 2


def test_counted_vectors_are_those_of_the_trie(spark):
    words = ["spelling", "über", "ÀÿéÖ", "zzz", "entaisrolhm"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = {r["word"]: list(r)[1:] for r in df.select("word", *variants._vector_columns()).collect()}
    assert [rows[w] for w in words] == variants.vectors_of(words).tolist()


def test_depth_follows_the_counts(spark):
    words = spark.createDataFrame([(a + b + "word", 2) for a in "abcdefghij" for b in "klmnopqrst"], "word string, n long")
    assert variants.subtree_depth(words, 100) == 0
    assert variants.subtree_depth(words, 60) > 0
    assert variants.subtree_depth(words, 1) == variants.GROUPS
    assert variants.subtree_depth(words.limit(0), 1) == 0


def test_one_edit():
    def told(a, b):
        rows = [np.frombuffer(x.encode("latin-1"), np.uint8)[None, :] for x in (a, b)]
        return bool(variants.one_edit(*rows)[0])

    assert told("abc", "abd") and told("abc", "abcd") and told("abcd", "bcd") and told("aa", "aaa")
    assert not told("abc", "abc") and not told("abc", "bca") and not told("abcd", "dabce"[:5]) and not told("ab", "bca")


def test_edges(spark, edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    clash = {c: F.lit("own") for c in "word n form form_n n_near subtree own asks length c0".split()}
    assert got(variants.spelling_variants(edges.withColumns(clash))) == direct(rows)
    assert got(variants.spelling_variants(edges, shortest=1, rarest=1, times=2)) == direct(rows, 1, 1, 2)
    assert variants.spelling_variants(nothing).count() == 0
