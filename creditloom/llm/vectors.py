"""Near-duplicate vectors by product quantisation.

1. Equal vectors form a class that is searched once, so copies cost nothing further.
2. A sample of at most ``SAMPLE`` classes fits the index: unit centres of coarse
   inverted lists, and codebooks for the residuals in ``SUBSPACES`` subspaces.
3. Every class is a member of the list of its nearest centre, with its residual's
   code, and visits further lists. List c is probed if the vector lies so near to
   the border between c and its own list that a partner at the threshold, in a
   direction drawn evenly, is behind that border with a probability of more than
   ``BEHIND`` standard deviations. A pair is missed only if neither vector probes
   the other's list.
4. In a list, table lookups give the asymmetric distance of a whole vector to each
   member's code. A member's own bound on the error of its code decides who is a
   candidate: no pair at the threshold is rejected there. Candidates are compared
   by their exact cosine.
5. A list is cut into blocks of about ``BLOCK`` rows by a hash, and pairs of blocks
   are the groups that tasks work on. A group returns one row a vector: how many
   others it links to there, and its component inside the group. Pairs are never
   rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.neardup import components
from creditloom.session import discard, materialise

#: Cosine from which vectors are linked.
LEAST = 0.9
#: Vectors that the index is fitted on at most, and lists at most; beyond them lists only grow longer.
SAMPLE, LISTS = 1 << 15, 1 << 11
SUBSPACES, CODES = 8, 256
BEHIND = 1.0
BLOCK = 4096
_ROUNDS = 12
#: Exact cosines that are computed at once.
_RERANK = 1 << 15
#: Single precision in the lookup tables.
_ROUNDING = 1e-4


class Index(NamedTuple):
    """What tasks need: its size is bounded by ``LISTS`` and the vectors' length."""

    centres: np.ndarray
    books: np.ndarray
    least: float

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; huge and tiny ones don't overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _padded(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, with zeros behind shorter ones, and their lengths."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(lengths), width))
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows, lengths


def _means(rows: np.ndarray, near: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The mean of each centre's rows; a centre without rows stays."""
    counts = np.bincount(near, minlength=len(old))
    order = np.argsort(near, kind="stable")
    starts = np.searchsorted(near[order], np.arange(len(old)))
    sums = np.add.reduceat(np.vstack([rows[order], np.zeros(rows.shape[1])]), starts, axis=0)
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = np.einsum("ij,ij->i", centres, centres) / 2
    parts = [np.argmax(rows[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _k_means(rows: np.ndarray, k: int, on_sphere: bool) -> np.ndarray:
    """Centres after ``_ROUNDS`` rounds from evenly spaced rows; the rows come in the order of a hash."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(_ROUNDS):
        centres = _means(rows, _nearest(rows, centres), centres)
        if on_sphere:
            lengths = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.divide(centres, lengths, out=centres, where=lengths > 0)
    return centres


def fit_index(sample: np.ndarray, total: int, least: float = LEAST) -> Index:
    """Fit lists, about the root of ``total`` of them, and codebooks to unit rows."""
    lists = int(max(1, min(LISTS, np.sqrt(total), len(sample) / 4)))
    centres = _k_means(sample, lists, True)
    width = -(-sample.shape[1] // SUBSPACES)
    residuals = np.zeros((len(sample), width * SUBSPACES))
    residuals[:, : sample.shape[1]] = sample - centres[_nearest(sample, centres)]
    parts = residuals.reshape(len(sample), SUBSPACES, width)
    books = [_k_means(parts[:, s], min(CODES, len(sample)), False) for s in range(SUBSPACES)]
    return Index(centres, np.array(books), least)


def encode(index: Index, rows: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals, and for each row the least lookup value of a partner at the threshold.

    Let e be the error of a row y's code and g = <y, e>. A unit partner at angle t
    is cos(t) y + sin(t) u with u at a right angle to y, so its lookup value is at
    least cos(t) (1 - g) - sin(t) |e - g y|, which grows with the cosine.
    """
    lists = index.centres[homes]
    width = index.books.shape[2]
    residuals = np.zeros((len(rows), SUBSPACES * width))
    residuals[:, : index.width] = rows - lists
    parts = residuals.reshape(len(rows), SUBSPACES, width)
    codes = np.stack([_nearest(parts[:, s], index.books[s]) for s in range(SUBSPACES)], axis=1)
    known = np.concatenate([index.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)[:, : index.width]
    error = rows - lists - known
    along = np.einsum("ij,ij->i", rows, error)
    across = np.sqrt(np.maximum(np.einsum("ij,ij->i", error, error) - along**2, 0))
    # With a code worse than nothing the bound does not grow with the cosine, so nothing is rejected.
    floor = np.where(along < 1, index.least * (1 - along) - np.sqrt(1 - index.least**2) * across, -np.inf)
    return codes.astype(np.uint8), floor - _ROUNDING


def probes(index: Index, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's own list, and a mask of the further lists that it probes."""
    centres = index.centres
    near = rows @ centres.T
    homes = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    gaps = near[np.arange(len(rows)), homes][:, None] - near
    slope = np.sqrt(1 - index.least**2) / index.least
    reach = BEHIND * slope / np.sqrt(max(1, index.width - 1))
    mask = gaps <= reach * apart[homes]
    mask[np.arange(len(rows)), homes] = False
    return homes, mask


_PLACED = (
    "list int, visits boolean, node long, copies long, home int, length int, floor double, code binary, "
    "probed array<int>, vector array<{kind}>"
)


def _placed(index: Index):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths = _padded(batch.column("vector"), index.width)
            if not len(rows):
                continue
            rows = unit(rows)
            homes, mask = probes(index, rows)
            codes, floor = encode(index, rows, homes)
            at, visited = np.nonzero(mask)
            probed = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(at, np.arange(len(rows) + 1)), pa.int32()), pa.array(visited, pa.int32())
            )
            take = np.concatenate([np.arange(len(rows)), at])
            kept = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([homes, visited]), pa.int32()),
                    pa.array(np.arange(len(take)) >= len(rows), pa.bool_()),
                    kept.column("node"),
                    kept.column("copies"),
                    pa.array(homes[take], pa.int32()),
                    pa.array(lengths[take], pa.int32()),
                    pa.array(floor[take], pa.float64()),
                    pa.array([codes[i].tobytes() for i in take], pa.binary()),
                    probed.take(pa.array(take)),
                    kept.column("vector"),
                ],
                names=[c.split()[0] for c in _PLACED.split(", ")],
            )

    return placed


def lookup(index: Index, at: int, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Asymmetric inner products of unit queries with the codes of members of list ``at``."""
    width = index.books.shape[2]
    wide = np.zeros((len(queries), SUBSPACES * width))
    wide[:, : index.width] = queries
    found = np.repeat((queries @ index.centres[at]).astype(np.float32)[:, None], len(codes), axis=1)
    for s in range(SUBSPACES):
        table = (wide[:, s * width : (s + 1) * width] @ index.books[s].T).astype(np.float32)
        found += table[:, codes[:, s]]
    return found


def forest(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """The smallest node that each of ``count`` nodes is connected to."""
    label = np.arange(count)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        # Hook the ends' roots, not only the ends, so that rounds grow with the logarithm of a chain.
        for ends in (left, right, label[left], label[right]):
            np.minimum.at(new, ends, least)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links_of(
    index: Index, at: int, queries: np.ndarray, members: np.ndarray, codes: np.ndarray, floor: np.ndarray, one: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) whose exact cosine reaches the threshold; ``one``: both are the same rows."""
    left, right = [], []
    step = max(1, (1 << 22) // max(1, len(members)))
    for i in range(0, len(queries), step):
        part = queries[i : i + step]
        likely = lookup(index, at, part, codes) >= floor
        if one:
            likely &= np.arange(len(members)) > np.arange(i, i + len(part))[:, None]
        a, b = np.nonzero(likely)
        for j in range(0, len(a), _RERANK):
            x, y = a[j : j + _RERANK], b[j : j + _RERANK]
            near = np.einsum("ij,ij->i", part[x], members[y]) >= index.least
            left.append(x[near] + i)
            right.append(y[near])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_FOUND = "node long, links long, tied long"


def _linked(index: Index):
    def linked(key: tuple, rows: pa.Table) -> pa.Table:
        at, split, low, high = (x.as_py() for x in key)
        rows = rows.combine_chunks()
        nodes = rows.column("node").to_numpy()
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows.take(pa.array(order)), nodes[order]
        copies, lengths = rows.column("copies").to_numpy(), rows.column("length").to_numpy()
        vectors = unit(_padded(rows.column("vector").combine_chunks(), index.width)[0])
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
        floor = rows.column("floor").to_numpy()
        block = rows.column("block").to_numpy()
        visits = rows.column("visits").to_numpy(zero_copy_only=False)
        one = not split and low == high
        asks = np.flatnonzero(visits if split else block == low)
        own = np.flatnonzero(~visits if split else block == high)
        a, b = links_of(index, at, vectors[asks], vectors[own], codes[own], floor[own], one)
        a, b = asks[a], own[b]
        keep = lengths[a] == lengths[b]
        if split:
            # A member that probes the visitor's list meets it there too; the smaller list counts the pair.
            probed = rows.column("probed").combine_chunks()
            starts = probed.offsets.to_numpy()
            width = int(np.diff(starts).max(initial=0))
            grid = np.full((len(nodes), max(1, width)), -1)
            grid[np.arange(max(1, width)) < np.diff(starts)[:, None]] = probed.flatten().to_numpy()
            home = rows.column("home").to_numpy()
            for i in range(0, len(a), _RERANK):
                x, y = a[i : i + _RERANK], b[i : i + _RERANK]
                keep[i : i + _RERANK] &= ~((home[x] < at) & (grid[y] == home[x][:, None]).any(axis=1))
        a, b = a[keep], b[keep]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        tied = nodes[forest(a, b, len(nodes))]
        seen = links > 0
        return pa.table({"node": nodes[seen], "links": links[seen], "tied": tied[seen]})

    return linked


def _block_pairs(placed: DataFrame, block: int) -> DataFrame:
    """Rows of ``placed`` in every group they belong to: (list, split, low, high)."""
    sizes = placed.groupBy("list").agg(
        F.count_if(~F.col("visits")).alias("n_members"), F.count_if("visits").alias("n_visits")
    )

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / block).cast("int")

    # As many rows as there are lists, which the index bounds.
    sizes = sizes.select("list", blocks("n_members").alias("own_blocks"), blocks("n_visits").alias("far_blocks"))
    mine = F.when(F.col("visits"), F.col("far_blocks")).otherwise(F.col("own_blocks"))
    rows = placed.join(F.broadcast(sizes), "list").withColumn(
        "block", F.pmod(F.xxhash64("node"), mine.cast("long")).cast("int")
    )

    def upto(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def group(split: bool, low: Column, high: Column) -> Column:
        return F.struct(F.lit(split).alias("split"), low.alias("low"), high.alias("high"))

    among = F.transform(upto("own_blocks"), lambda x: group(False, F.least(x, "block"), F.greatest(x, "block")))
    asked = F.transform(upto("far_blocks"), lambda x: group(True, x, F.col("block")))
    asking = F.transform(upto("own_blocks"), lambda x: group(True, F.col("block"), x))
    groups = F.when(F.col("visits"), asking).otherwise(F.concat(among, asked))
    return rows.withColumn("group", F.explode(groups)).select("*", "group.split", "group.low", "group.high").drop(
        "group", "own_blocks", "far_blocks"
    )


def _usable(vector: Column) -> Column:
    """Vectors that a cosine is defined for."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """The links and the component of every row of ``vectors`` (vec_id, embedding).

    Rows are linked if the cosine of their vectors is ``least`` or more. Returns
    vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable by links, the row's own included) and kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, and so do rows with a null vec_id, whose component is null and
    which are kept. Vectors of different lengths are not linked. Repeated rows are
    linked like any equal vectors, and so are different vectors under one vec_id.
    Vectors of any length are searched whole; an empty table gives no rows. Other
    columns are not read.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector")
    )
    # Two hashes of 64 bits name a vector.
    usable = F.col("vec_id").isNotNull() & _usable(F.col("vector"))
    named = [F.when(usable, F.xxhash64(F.lit(i), "vector")).alias(f"key{i}") for i in (1, 2)]
    rows = materialise(rows.select("vec_id", "vector", *named), "vectors-rows")
    keys = ["key1", "key2"]
    classes = rows.filter("key1 IS NOT NULL").groupBy(*keys).agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vectors-classes")
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if total:
        drawn = classes.orderBy(*keys).select("vector").limit(SAMPLE).toArrow().column("vector").combine_chunks()
        index = fit_index(unit(_padded(drawn, width)[0]), total, least)
        placed = classes.select("node", "copies", "vector").mapInArrow(_placed(index), _PLACED.format(kind=kind))
        placed = materialise(placed, "vectors-placed")
        groups = _block_pairs(placed, block).groupBy("list", "split", "low", "high")
        found = materialise(groups.applyInArrow(_linked(index), _FOUND), "vectors-found")
        discard(placed)
    else:
        found = classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("tied"))
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    homes = components(found.filter("node != tied").select(F.col("tied").alias("a"), F.col("node").alias("b")))
    told = (
        classes.drop("vector")
        .join(degrees, "node", "left")
        .join(homes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    told = materialise(
        told.select(*keys, "least_id", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")),
        "vectors-told",
    )
    least_ids = told.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = told.join(least_ids, "component").select(*keys, "n", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(told, keys, "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"),
    )
