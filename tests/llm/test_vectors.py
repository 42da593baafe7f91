"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import vectors

SCHEMA = "vec_id long, embedding array<double>"


def all_pairs(rows, least=vectors.LEAST):
    """Links and components by comparing every vector with every other."""
    good = [
        (i, np.array(v, float) / max(map(abs, v)))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    parent = list(range(len(good)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(good)
    for a, (_, x) in enumerate(good):
        for b in range(a):
            y = good[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least_id = {}
    for k, (i, _) in enumerate(good):
        least_id[root(k)] = min(i, least_id.get(root(k), i))
    found = [(i, links[k], least_id[root(k)]) for k, (i, _) in enumerate(good)]
    return sorted(found)


def clouds(seed, families, size, spread, width=24, lone=200):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(families, width))
    near = centres[:, None] + spread * rng.normal(size=(families, size, width)) * np.linalg.norm(centres, axis=1)[
        :, None, None
    ] / np.sqrt(width)
    rows = np.concatenate([near.reshape(-1, width), rng.normal(size=(lone, width))])
    return [(int(i), r.tolist()) for i, r in zip(rng.permutation(len(rows)) + 1, rows, strict=True)]


def found(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 40])
def test_families_equal_all_pairs(spark, block):
    rows = clouds(1, 12, 30, 0.2)
    got = found(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block))
    assert got == all_pairs(rows)


def test_recall_at_the_threshold(spark):
    rows = clouds(5, 250, 4, 0.33, width=32, lone=1000)
    want, got = all_pairs(rows), found(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert sum(n for _, n, _ in want) > 500
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(n for _, n, _ in got) >= 0.98 * sum(n for _, n, _ in want)


def test_lookups_reject_no_link():
    rng = np.random.default_rng(2)
    rows = vectors.unit(np.array([v for _, v in clouds(3, 300, 5, 0.32)]))
    index = vectors.fit_index(rows[rng.permutation(len(rows))[:600]], len(rows))
    homes, _ = vectors.probes(index, rows)
    codes, floor = vectors.encode(index, rows, homes)
    exact = rows @ rows.T >= vectors.LEAST
    rejected = 0
    for at in range(len(index.centres)):
        own = np.flatnonzero(homes == at)
        likely = vectors.lookup(index, at, rows, codes[own]) >= floor[own]
        assert not (exact[:, own] & ~likely).any()
        rejected += (~likely).sum()
    assert rejected > 0.5 * len(rows) ** 2


def test_forest():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, (2, 200))
    label = vectors.forest(a, b, 300)
    assert (label[a] == label[b]).all() and (label[label] == label).all() and (label <= np.arange(300)).all()
    chain = np.arange(999)
    assert (vectors.forest(chain, chain + 1, 1000) == 0).all()


def test_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, None),
        (2, []),
        (3, [0.0, 0.0, 0.0]),
        (4, [1.0, None, 3.0]),
        (5, [1.0, float("nan"), 3.0]),
        (6, [1.0, float("inf"), 3.0]),
        (None, one),
        (9, one),
        (8, one),
        (8, one),
        (10, [x * 1e200 for x in one]),
        (11, [x * 1e-200 for x in one]),
        (12, [-x for x in one]),
        (13, [1.0, 2.0]),
        (14, [1.0, 2.0, 3.0, 0.0]),
        (15, [5.0, 0.0, 0.0]),
        (15, [0.0, 5.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("own") for c in "label node list copies links n_links component_id key1 vector kept".split()}
    got = vectors.near_vectors(df.withColumns(clash)).collect()
    told = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None)
    want = all_pairs(rows)
    usable = {i for i, _, _ in want}
    want = [(i, n, c, i == c) for i, n, c in want] + [(i, 0, i, True) for i in range(1, 7) if i not in usable]
    assert told == sorted(want)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]


def test_copies_are_one_class(spark):
    rows = [(i, [1.0, 0.5] * 8) for i in range(500)] + [(1000 + i, [1.0, 0.5 + i / 1e4] * 8) for i in range(3)]
    assert found(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA))) == [
        (i, 502, 0) for i, _ in rows
    ]


def test_empty_and_unusable(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(vectors.near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA))) == [(1, 0, 1), (2, 0, 2)]
    floats = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")
    assert found(vectors.near_vectors(floats)) == [(1, 1, 1), (2, 1, 1)]


def test_table_equals_all_pairs(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert found(vectors.near_vectors(table)) == all_pairs(rows)
