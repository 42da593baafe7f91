"""Near duplicates against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from creditloom.llm import neardup


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def by_hand(rows, percent=85):
    """doc_id to (shingles, component) by testing every pair."""
    ids = [i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    home = list(range(len(rows)))

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if not sets[a] or not sets[b] or ids[a] is None or ids[b] is None:
                continue
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                home[root(a)] = root(b)
    best = {}
    for x, i in enumerate(ids):
        if i is not None:
            best[root(x)] = min(best.get(root(x), i), i)
    return sorted(
        str((i, len(sets[x]), best.get(root(x)) if i is not None else None, i is None or best[root(x)] == i))
        for x, i in enumerate(ids)
    )


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(df).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got) == by_hand(rows)


@pytest.mark.parametrize("source", ["documents", "edges"])
def test_tables(request, source):
    check(request.getfixturevalue(source))


def changed(words, draw, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**6)}"
    return out


def test_chains_and_large_groups(spark):
    """A chain whose ends are unlike, a group around a centre, near misses, copies and short texts."""
    draw = random.Random(11)
    rows, base = [], [f"w{draw.randrange(5000)}" for _ in range(400)]
    for _ in range(25):
        rows.append(list(base))
        base = changed(base, draw, 3)
    centre = [f"v{draw.randrange(5000)}" for _ in range(300)]
    for i in range(150):
        rows.append(changed(centre, draw, i % 12))
    for n in range(1, 12):
        short = [f"s{n}{i}" for i in range(n)]
        rows += [short, list(short), short[:-1] + ["end"], short + ["more"]]
    rows += [centre] * 20
    draw.shuffle(rows)
    check(spark.createDataFrame([(1000 - i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string"))


def test_links_away_from_the_centre(spark):
    """Documents that share bands with many but are linked to few: the rest pass must find those links."""
    draw = random.Random(2)
    rows = []
    for _ in range(12):
        common = [f"c{draw.randrange(10**6)}" for _ in range(200)]
        families = [changed(common, draw, 14) for _ in range(6)]
        for family in families:
            rows += [changed(family, draw, 2) for _ in range(4)]
    draw.shuffle(rows)
    check(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string"))


def test_estimate_is_unbiased(spark):
    draw = random.Random(4)
    hashes = neardup._Hashes()
    rows, exact = [], []
    for n in range(200):
        a = [f"x{draw.randrange(10**6)}" for _ in range(1500)]
        b = a[: 750 + 3 * n] + [f"y{draw.randrange(10**6)}" for _ in range(750 - 3 * n)]
        for words in (a, b):
            found = neardup.registers_of(neardup.shingle_hashes([w.encode() for w in words], hashes))
            rows.append(neardup.tagged(found).tolist())
        sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
        exact.append(len(sa & sb) / len(sa | sb))
    df = spark.createDataFrame(
        [(i, rows[2 * i], rows[2 * i + 1]) for i in range(200)], "id int, a array<int>, b array<int>"
    )
    found = df.select("id", neardup.estimated_similarity(df["a"], df["b"]).alias("e")).orderBy("id").collect()
    off = np.array([r["e"] for r in found]) - exact
    assert abs(off.mean()) < 0.01 and np.abs(off).max() < neardup.SLACK


def template_family(draw, size, choices):
    """Documents of one template, 0.7 to 0.8 alike: a few of its words are drawn from few ``choices``, if any."""
    base = [f"t{draw.randrange(10**6)}" for _ in range(200)]
    slots = draw.sample(range(4, 196), 6)
    rows = []
    for i in range(size):
        out = list(base)
        for at in draw.sample(slots, 5):
            out[at] = f"v{at}x{draw.randrange(choices) if choices else f'{i}u'}"
        rows.append(out)
    return rows


@pytest.mark.parametrize("choices", [0, 4])
@pytest.mark.parametrize("meeting", [neardup.MEETING, 7])
def test_template_families(spark, monkeypatch, choices, meeting):
    """Links equal brute force where most documents of a family resemble each other without reaching the threshold."""
    monkeypatch.setattr(neardup, "MEETING", meeting)
    draw = random.Random(choices)
    rows = [r for _ in range(2) for r in template_family(draw, 60, choices)]
    check(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string"))


def test_unlike_members_of_a_bucket_make_no_pairs(spark):
    """One large bucket of documents 0.7 to 0.8 alike: the prefix filter makes hardly any of its pairs."""
    rows = template_family(random.Random(3), 150, 0)
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    shared = docs.select("doc_id", F.lit(1).cast("long").alias("band"), F.lit(150).cast("long").alias("members"))
    alone = spark.createDataFrame([], "node long, component long")
    assert neardup._rest_pairs(shared, alone, docs, 85).count() < 150


@pytest.mark.parametrize("words", [75, 150, 600, 4000])
@pytest.mark.parametrize("percent", [80, 85])
def test_finer_sketch_rejects_no_link(words, percent):
    """Pairs just above the threshold pass the finer sketch, short documents by a narrow margin."""
    draw = random.Random(words + percent)
    hashes, links, floors = neardup._Hashes(), 0, []
    for _ in range(400):
        a = [f"x{draw.randrange(10**9)}".encode() for _ in range(words)]
        b = list(a)
        for i in range(max(1, round(words * (100 - percent) / (100 + percent) / 5) + draw.randrange(-1, 1))):
            b[(2 * i + 1) * 11 % words if words < 100 else draw.randrange(words)] = f"y{draw.randrange(10**9)}".encode()
        found = [neardup.shingle_hashes(w, hashes) for w in (a, b)]
        common = len(np.intersect1d(*found))
        if 100 * common < percent * (len(found[0]) + len(found[1]) - common):
            continue
        links += 1
        fine = [neardup.registers_of(x, neardup.FINE_REGISTERS).astype(np.uint16) for x in found]
        likeness, filled = neardup.alike(fine[0], fine[1][None, :])
        floor = neardup.fine_floor(np.array([len(found[0]) + len(found[1])]), filled, percent)
        assert likeness[0] >= floor[0]
        floors.append(floor[0])
    assert links > 50 and min(floors) > percent / 100 - (0.15 if words == 75 else 0.1)


def test_first_shingles_meet_in_every_similar_pair(spark):
    draw = random.Random(5)
    sets = []
    for _ in range(30):
        base = [draw.randrange(400) for _ in range(draw.randrange(1, 90))]
        sets += [sorted({x if draw.random() > 0.06 else draw.randrange(400) for x in base}) for _ in range(6)]
    details = spark.createDataFrame(list(enumerate(sets)), "doc_id long, shingles array<long>")
    for percent in (80, 85):
        firsts = {}
        for r in neardup._first_shingles(details, percent).collect():
            firsts.setdefault(r["doc_id"], {})[r["shingle"]] = r["short"]
        similar = 0
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                common = len(set(x) & set(y))
                if (len(x), a) < (len(y), b) and 100 * common >= percent * (len(x) + len(y) - common):
                    similar += 1
                    assert any(s and k in firsts.get(b, {}) for k, s in firsts.get(a, {}).items())
        assert similar > 50


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {100: 99, 101: 99}


def test_deduplicated_keeps_one_of_each_group(edges, nothing):
    got = neardup.deduplicated(edges)
    kept = [r["doc_id"] for r in got.collect()]
    assert got.columns == edges.columns
    # 5 and 6 repeat 4, 8 is near 7, the row 11 is there twice; null identifiers stay.
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 7, 9, 11, 12, 13, 14, 15, None, None], key=str)
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.deduplicated(nothing).count() == 0


def spread(words, n, mark):
    """``words`` with ``n`` words changed, far apart."""
    out = list(words)
    for i in range(n):
        out[(2 * i + 1) * len(out) // (2 * n)] = f"{mark}{i}"
    return out


def test_stage_of_the_pipeline_links_from_80_percent_on(spark):
    """Pairs at 0.80 and between 0.80 and 0.85 are near copies in the stage and not in op8; pairs below are in neither."""
    draw = random.Random(21)
    rows = []
    for i in range(30):
        base = [f"b{draw.randrange(10**6)}" for _ in range(200)]
        rows += [base, spread(base, 4 + i % 2, f"m{i}x")]
        short = [f"e{draw.randrange(10**6)}" for _ in range(49)]
        rows += [short, spread(short, 1, f"n{i}x")]
    centre = [f"c{draw.randrange(10**6)}" for _ in range(200)]
    rows += [spread(centre, i % 6, f"g{i}x") for i in range(40)]
    draw.shuffle(rows)
    rows = [(i, " ".join(r), "en", "a", 1) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def kept(percent):
        verdicts = by_hand([r[:2] for r in rows], percent)
        return sorted(int(v[1:].split(",")[0]) for v in verdicts if v.endswith("True)"))

    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == kept(80)
    assert len(got) < len(kept(85))


def test_bands_follow_the_threshold():
    assert [neardup.bands_for(p) for p in (100, 95, 85, 80)] == [25, 25, 25, 37]
    for percent in (85, 80, 70):
        assert (1 - (percent / 100) ** neardup.BAND_WIDTH) ** neardup.bands_for(percent) <= neardup.MISSED
