"""Quality rules, shards and mixing against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from creditloom.llm import mixing, quality, sharding

WORD = re.compile("[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = collections.Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if counts[w] > 1 for o in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_measures(request, source, labels):
    docs = request.getfixturevalue(source)
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    want = sorted(((i, *measures(t)) for i, t in texts), key=str)
    rows = quality.score_quality(docs, labels).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 10, 300, 2500) for k in (0, 1, 3, 9) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long")
    for r in df.withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        exact = math.fsum(math.comb(r["n"], j) * 0.02**j * 0.98 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert r["p"] == pytest.approx(exact, rel=1e-9)


def test_certified_cutoffs_bound_false_rejection(spark):
    """2,000 good documents, of which 4 have a ratio of 0.3: 0.2 % fits a risk of 1 %, 40 don't."""
    rules = {"symbols_per_word": (1, (0.5, 0.25, 0.1))}
    rows = [
        (i, s, 100, 500, 30 if i < 4 else 15 if i < 40 else 0, 0, 0, False)
        for s in ("len", "lde")
        for i in range(2000 if s == "len" else 60)
    ]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    schema = (
        "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean"
    )
    df = spark.createDataFrame(rows, schema)
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    found = quality.certified_cutoffs(df, labels, rules, risk=0.01, level=0.05).collect()
    cutoffs = {r["stratum"]: r["symbols_per_word_cutoff"] for r in found}
    assert cutoffs == {"len": 0.25, "lde": None}  # sixty documents can't certify anything
    judged = quality.judge(df, quality.certified_cutoffs(df, labels, rules, risk=0.01, level=0.05), rules)
    assert judged.filter("NOT kept").groupBy("stratum").count().collect() == [("len", 4)]


RATED = (
    "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean"
)


def test_repeated_rows_and_labels_are_one_trial(spark):
    """Copies add no evidence: five labels and rows of each document certify what one does."""
    rules = {"symbols_per_word": (1, (1.0, 0.5, 0.05))}
    rows = [(i, "len", 100, 500, 10 if i < 6 else 0, 0, 0, False) for i in range(2000)]
    once = spark.createDataFrame(rows, RATED)
    five = once.unionAll(once).unionAll(once).unionAll(once).unionAll(once)
    cutoffs = [
        quality.certified_cutoffs(df, df.select("doc_id", F.lit(1).alias("quality")), rules, 0.005, 0.0125).first()
        for df in (once, five)
    ]
    assert cutoffs[0] == cutoffs[1] and cutoffs[0]["good"] == 2000 and cutoffs[0]["symbols_per_word_cutoff"] == 0.5


@pytest.mark.parametrize("overlap", [True, False])
def test_rules_together_stay_within_the_risk(spark, overlap):
    """Two rules that reject the same documents, or different ones, never reject more than the stratum's risk."""
    rules = {"symbols_per_word": (1, (0.5, 0.3, 0.1)), "dup_lines_per_word": (1, (0.5, 0.3, 0.1))}
    n, risk = 6000, 0.01

    def level(i, start):
        """Of the documents from ``start`` on 0.1 % are beyond 0.5, 0.3 % beyond 0.3 and 0.8 % beyond 0.1."""
        place = (i - start) % n
        return 60 if place < 6 else 40 if place < 18 else 20 if place < 48 else 0

    rows = [(i, "len", 100, 500, level(i, 0), level(i, 0 if overlap else 100), 0, False) for i in range(n)]
    df = spark.createDataFrame(rows, RATED)
    cutoffs = quality.certified_cutoffs(df, df.select("doc_id", F.lit(1).alias("quality")), rules, risk, 0.05)
    found = cutoffs.first()
    # A rule may use half of the risk, and 0.8 % is beyond that even where both reject the same documents.
    assert [found[f"{r}_cutoff"] for r in rules] == [0.3, 0.3]
    assert 0 < quality.judge(df, cutoffs, rules).filter("NOT kept").count() <= risk * n


def test_quality_without_labels_or_rows(edges, nothing, no_labels):
    rows = quality.score_quality(edges, no_labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert quality.score_quality(nothing, no_labels).count() == 0
    kept = quality.good_documents(edges, no_labels)
    assert kept.columns == edges.columns and kept.count() == sum(r["kept"] for r in rows) > 0


def test_shards_follow_the_mixture(documents):
    rows = sharding.assign_shards(documents, shards=8).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    by_source = collections.Counter((r["source"], r["shard"]) for r in rows)
    for source, n in collections.Counter(r["source"] for r in rows).items():
        assert all(abs(by_source[source, s] - n / 8) < 2 for s in range(8))


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_shards_by_brute_force(request, source):
    docs = request.getfixturevalue(source).collect()

    def key(i):
        return hashlib.md5(f"shard-0:{'null' if i is None else i}".encode()).hexdigest()

    strata = collections.defaultdict(list)
    for r in docs:
        raw = (r["text"] or "").encode()
        mark = "n" if r["source"] is None else "s" + r["source"]
        strata[mark].append((key(r["doc_id"]), str(r["doc_id"]), zlib.crc32(raw), len(raw) + 8, r["doc_id"]))
    line = []
    for name, own in strata.items():
        line += [((n + 0.5) / len(own), name, x) for n, x in enumerate(sorted(own))]
    want = []
    for position, (_, _, x) in enumerate(sorted(line)):
        shard = position * 24 // len(line)
        want.append((x[4], x[3], x[2], shard, position - -(-shard * len(line) // 24)))
    got = sharding.assign_shards(request.getfixturevalue(source)).collect()
    assert sorted(map(str, want)) == sorted(
        str((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])) for r in got
    )
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def mixed_by_hand(rows, weights=(3, 1, 2), share=1.5, repeats=2):
    sources = collections.defaultdict(list)
    for n, r in enumerate(rows):
        name = "z" if r["source"] is None else "s" + r["source"]
        key = hashlib.md5(f"mix-0:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        sources[name].append((key, str(r["doc_id"]), len(WORD.findall(r["text"] or "")), n))
    size = {s: sum(x[2] for x in own) for s, own in sources.items()}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(size, key=lambda s: s.encode()))}
    budget = sum(size.values()) * share
    capped = set()
    while True:
        free = [s for s in size if s not in capped]
        room = budget - sum(size[s] * repeats for s in capped)
        level = room / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if size[s] * repeats < weight[s] * level}
        if not over:
            break
        capped |= over
    targets = {s: size[s] * repeats if s in capped else weight[s] * level for s in size}
    queue = []
    for s, own in sources.items():
        total = 0
        for turn in range(repeats):
            for x in sorted(own):
                if x[2]:
                    total += x[2]
                    queue.append((total / weight[s], s, turn, x))
    taken, served = collections.Counter(), 0
    for _, _, _, x in sorted(queue):
        served += x[2]
        if served <= budget:
            taken[x[3]] += x[2]
    return targets, size, taken


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_mix_by_brute_force(request, source):
    df = request.getfixturevalue(source)
    rows = df.collect()
    targets, size, taken = mixed_by_hand(rows)
    want = sorted(
        str((r["doc_id"], len(WORD.findall(r["text"] or "")), size[s], taken[n]))
        for n, r in enumerate(rows)
        for s in ["z" if r["source"] is None else "s" + r["source"]]
    )
    got = mixing.mix(df).collect()
    assert sorted(str((r["doc_id"], r["size"], r["source_size"], r["taken"])) for r in got) == want
    for r in got:
        assert r["target"] == pytest.approx(targets["z" if r["source"] is None else "s" + r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])


def test_mix_comes_near_its_targets_and_repeats_itself(documents):
    first = mixing.mix(documents).orderBy("doc_id").collect()
    assert first == mixing.mix(documents.repartition(7)).orderBy("doc_id").collect()
    longest = max(r["size"] for r in first)
    for source in {r["source"] for r in first}:
        own = [r for r in first if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * longest


def test_mixed_documents_repeat_whole_rows(edges):
    want = {}
    for r in mixing.mix(edges).filter("size > 0").collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"] // r["size"]
    got = mixing.mixed_documents(edges)
    assert got.columns == edges.columns
    counted = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counted == {k: v for k, v in want.items() if v}


def test_empty_tables(nothing):
    assert sharding.assign_shards(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
