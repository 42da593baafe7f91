"""Near-duplicate documents by HyperMinHash.

Every document gets a sketch of ``REGISTERS`` buckets. A shingle's 64-bit hash
names its bucket (its place in the range of hashes), and the smallest hash of a
bucket is kept as a compressed register: its count of leading zeros and the
first ``MANTISSA`` bits after them. Runs of registers are the bands; documents
with an equal band are candidates.

1. Documents with equal word sequences form a class; its smallest doc_id stands
   for it, so that copies cost nothing further.
2. In every band bucket each document is paired with two members: the one whose
   bands are shared most, as the middle of a family is, and one drawn by hash,
   with one of ``DRAWS`` hashes in every band. Bands that share a hash draw the
   same member of a family, so a document has few pairs, no matter how large its
   buckets are.
3. Pairs whose estimated similarity (equal registers less the collisions that
   compression causes, by non-empty registers) may reach the threshold are
   confirmed on the full shingle sets. Linked classes become components.
4. Members of buckets of three or more that still hold several components are
   paired by an exact prefix filter. Shingles are ordered by the number of these
   documents that hold them, the rarest first. A pair at the threshold has a
   shingle in common among the first few of both: few enough that the shingles
   that nobody else has, which come first and make no rows, use them up in most
   documents that resemble others without reaching the threshold. Where documents
   meet at a shingle, a task compares finer sketches, which hold short documents
   almost whole, and only pairs that these allow become rows. Pairs inside a
   component can't change the result, so no link between components is left out.

With 25 bands of 5 registers a pair at similarity 0.85 shares no band with a
probability of 4e-7. Lower thresholds get more bands, so that a pair at the
threshold is missed no more often: 37 at 0.80.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.session import materialise

#: Fewest bands, and registers of a band.
BANDS, BAND_WIDTH = 25, 5
#: A pair at the threshold may share no band with this probability at most.
MISSED = 5e-7
REGISTERS = BANDS * BAND_WIDTH
MANTISSA = 10
SHINGLE = 5
#: Hashes that members of buckets are drawn by.
DRAWS = 8
#: Percent of the union that the intersection must reach, as op8's contract has it; the pipeline passes its own.
PERCENT = 85
#: Estimates this far under the threshold are still confirmed on the sets (over five standard deviations).
SLACK = 0.17
#: Expected share of registers of unrelated documents that agree, after compression (Yu and Weber, 2017).
COLLISION = 0.169919487159739 / 2**MANTISSA

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Registers of the finer sketch, which only members of mixed buckets get, and how many standard deviations under the
#: threshold it may be.
FINE_REGISTERS, DEVIATIONS = 512, 5.1
#: About as many documents with one shingle among their first meet in a task; more are cut by a hash.
MEETING = 1 << 10
#: Slots of the filter that keeps most other texts out of a shuffle; never more rows than that are broadcast.
FILTER_SLOTS = 1 << 20
#: Words whose hashes a worker remembers.
_REMEMBERED = 1 << 17

SKETCH = "doc_id long, word_key binary, n_shingles long, registers array<int>, bands array<long>"


def bands_for(percent: int) -> int:
    """Bands with which a pair at the threshold is ``MISSED`` at most."""
    if percent >= 100:
        return BANDS
    return max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** BAND_WIDTH))))


@lru_cache(maxsize=8)
def _edges(count: int) -> np.ndarray:
    return np.array([(i << 64) // count for i in range(count)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes split at exactly the six white space characters."""
    return (text or "").encode().translate(LOWER).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than one shingle are one."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(codes))
    places = len(codes) - width + 1
    total = np.full(places, width, np.uint64)
    for i in range(width):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + places])
    return np.unique(total)


def registers_of(shingles: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """A register for each of ``count`` buckets; 0 where the bucket is empty.

    Sorted hashes lie in the order of their buckets, so a bucket's smallest hash
    is the first one at or after its edge.
    """
    edges = _edges(count)
    first = np.searchsorted(shingles, edges)
    empty = first == np.append(first[1:], len(shingles))
    offsets = shingles[np.minimum(first, len(shingles) - 1)] - edges if len(shingles) else edges
    share = offsets.astype(np.float64) * (count / 2.0**64)
    fraction, exponent = np.frexp(np.maximum(share, 2.0**-60))
    zeros = np.clip(-exponent, 0, 62)
    bits = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(empty, 0, 1 + np.minimum((zeros << MANTISSA) + bits, 65534)).astype(np.uint64)


def tagged(registers: np.ndarray) -> np.ndarray:
    """The non-empty registers, each with its place in the upper bits."""
    places = np.arange(len(registers), dtype=np.int64) << 16
    return (places + registers.astype(np.int64))[registers > 0].astype(np.int32)


def _sketches(n_bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        seeds = _mixed(np.arange(1, n_bands + 1, dtype=np.uint64))
        for batch in batches:
            keys, counts, marked, bands = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                shingles = shingle_hashes(words, hashes)
                registers = registers_of(shingles, n_bands * BAND_WIDTH)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                counts.append(len(shingles))
                marked.append(tagged(registers))
                grid = registers.reshape(n_bands, BAND_WIDTH)
                band = seeds
                for i in range(BAND_WIDTH):
                    band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + grid[:, i])
                bands.append(band[grid.any(axis=1)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(keys, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(marked, pa.list_(pa.int32())),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "word_key", "n_shingles", "registers", "bands"],
            )

    return sketched


def sketch(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """Sketch every row of ``docs`` (doc_id, text) in ``n_bands`` bands.

    ``word_key`` is a 128-bit hash of the word sequence; ``registers`` holds the
    non-empty ones, each with its place in the upper bits.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(_sketches(n_bands), SKETCH)


def estimated_similarity(left: Column, right: Column) -> Column:
    """Similarity of two lists of tagged registers, corrected for chance collisions.

    The share is of the longer list, which rather overestimates documents that
    are too short to fill all registers.
    """
    share = F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.size(right))
    return (share - F.lit(COLLISION)) / F.lit(1 - COLLISION)


def _shingle_set(text: str | None) -> set:
    words = words_of(text)
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, known = None, set()
    for batch in batches:
        counts = []
        left, right = batch.column("left_text"), batch.column("right_text")
        for i, a in enumerate(batch.column("a").to_pylist()):
            if last != a:
                last, known = a, _shingle_set(left[i].as_py())
            other = _shingle_set(right[i].as_py())
            counts.append((len(known & other), len(known), len(other)))
        columns = zip(*counts, strict=True) if counts else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in columns)],
            names=["a", "b", "both", "of_a", "of_b"],
        )


def intersections(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs (a, b) the sizes both, of_a and of_b of their full shingle sets."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right_text"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text").mapInArrow(
        _intersect, "a long, b long, both long, of_a long, of_b long"
    )


def confirmed_links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    similar = (F.col("both") > 0) & (F.col("both") * 100 >= (F.col("of_a") + F.col("of_b") - F.col("both")) * percent)
    return intersections(pairs, texts).filter(similar).select("a", "b")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the threshold."""
    sketches = reps.select("doc_id", "registers")
    left = sketches.select(F.col("doc_id").alias("a"), F.col("registers").alias("left_registers"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("registers").alias("right_registers"))
    close = estimated_similarity(F.col("left_registers"), F.col("right_registers")) >= percent / 100 - SLACK
    return pairs.join(left, "a").join(right, "b").filter(close).select("a", "b")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """The smallest reachable node for every node of the links (a, b).

    Large-star and small-star steps in turn (Kiveris et al., 2014): neighbours
    are tied to the smallest node in reach until every node is tied to the
    smallest of its component. Each round is written, so a lost executor costs
    no more than the round. Rounds grow with the logarithm of the size.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        tied = near.filter("b > a") if large else near
        moved = tied.join(least, "a").select(F.col("b").alias("node"), F.col("least"))
        if not large:
            moved = moved.union(least.select(F.col("a").alias("node"), "least"))
        return moved.filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    before = state(edges)
    while True:
        edges = materialise(star(star(edges, True), False), name)
        now = state(edges)
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = now


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, band, members) of shared bands, and pairs with their buckets' centers."""
    entries = reps.select("doc_id", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count(F.lit(1)).alias("members"))
    shared = materialise(entries.join(buckets.filter("members > 1"), "band"), "dedup-bands")
    fame = shared.groupBy("doc_id").agg(F.sum("members").alias("fame"))
    centers = (
        shared.join(fame, "doc_id")
        .groupBy("band")
        .agg(
            F.max_by("doc_id", F.struct("fame", F.xxhash64("doc_id"))).alias("known"),
            F.min_by("doc_id", F.xxhash64("doc_id", F.pmod("band", F.lit(DRAWS)))).alias("drawn"),
        )
    )
    met = shared.join(centers, "band").select("doc_id", F.explode(F.array("known", "drawn")).alias("center"))
    pairs = met.filter("doc_id != center").select(
        F.least("doc_id", "center").alias("a"), F.greatest("doc_id", "center").alias("b")
    )
    return shared, pairs.distinct()


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        found = [shingle_hashes(words_of(x.as_py()), hashes) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                pa.array([registers_of(x, FINE_REGISTERS).astype(np.uint16).tobytes() for x in found], pa.binary()),
            ],
            names=["doc_id", "shingles", "fine"],
        )


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents ``ids``, one for each.

    A filter of fixed size, the hash slots that any of the ids falls in, lets
    only them and a few others into the shuffle of the exact join.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def slot() -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_SLOTS)).cast("int")

    slots = ids.select(slot().alias("_slot")).distinct()
    near = thin.withColumn("_slot", slot()).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
    return near.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _first_shingles(details: DataFrame, percent: int) -> DataFrame:
    """Rows (doc_id, n, shingle, place, short) of the first shared shingles of every document.

    Let a pair reach the threshold, of sizes m <= n. It has at least
    percent * (m + n) / (100 + percent) shingles in common, which is no less than
    2 * percent * m / (100 + percent), nor than percent * n / 100 as m is that
    large. So the longer document holds a common shingle among its first
    n - percent * n / 100 + 1, and the shorter one already among its first
    m - 2 * percent * m / (100 + percent) + 1, both in one order of all shingles;
    ``short`` marks the latter.
    """
    single = details.select("doc_id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    held = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    known = single.join(held, "shingle").groupBy("doc_id", "n").agg(
        F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("known")
    )

    def first(part: int, whole: int) -> Column:
        return F.col("n") - F.ceil(F.col("n") * part / whole) + 1

    own = F.col("n") - F.size("known")
    firsts = known.select("doc_id", "n", own.alias("own"), F.posexplode(
        F.slice("known", F.lit(1), F.greatest(first(percent, 100) - own, F.lit(0)).cast("int"))
    ).alias("at", "one"))
    place = F.col("own") + F.col("at")
    return firsts.select(
        "doc_id", "n", "one.shingle", place.alias("place"), (place < first(2 * percent, 100 + percent)).alias("short")
    )


def alike(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of one row of registers to each row of ``right``, and how many registers either fills."""
    filled = np.maximum(((left > 0) | (right > 0)).sum(axis=1), 1)
    share = ((left == right) & (left > 0)).sum(axis=1) / filled
    return (share - COLLISION) / (1 - COLLISION), filled


def fine_floor(shingles: np.ndarray, filled: np.ndarray, percent: int) -> np.ndarray:
    """The least estimate that a pair at the threshold, with so many shingles in both sets together, may have.

    A filled register shows one shingle of the union, drawn without putting back:
    the more of the union is seen, the less an estimate strays.
    """
    share = percent / 100
    unseen = np.maximum(1 - filled * (1 + share) / shingles, 0)
    return share - DEVIATIONS * np.sqrt(share * (1 - share) * unseen / filled) - 1 / filled


def _meet(percent: int):
    def met(rows: pa.Table) -> pa.Table:
        """Pairs of one group: a shorter and a longer document of different components that may reach the threshold."""
        n, place, doc_id, component = (rows.column(c).to_numpy() for c in ("n", "place", "doc_id", "component"))
        fine = np.frombuffer(b"".join(rows.column("fine").to_pylist()), np.uint16).reshape(-1, FINE_REGISTERS)
        longs = np.flatnonzero(rows.column("as_long").to_numpy(zero_copy_only=False))
        left, right = [], []
        for a in np.flatnonzero(rows.column("as_short").to_numpy(zero_copy_only=False)):
            b = longs
            # Shorter first, by doc_id among equals; not too short; and what lies before the shingle on either side,
            # itself, and what lies behind it must be able to suffice.
            common = np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b])
            able = (n[a] < n[b]) | ((n[a] == n[b]) & (doc_id[a] < doc_id[b]))
            able &= (component[a] != component[b]) & (n[a] * 100 >= n[b] * percent)
            able &= common * (100 + percent) >= (n[a] + n[b]) * percent
            b = b[able]
            likeness, filled = alike(fine[a], fine[b])
            b = b[likeness >= fine_floor(n[a] + n[b], filled, percent)]
            left.append(np.minimum(doc_id[a], doc_id[b]))
            right.append(np.maximum(doc_id[a], doc_id[b]))
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([none, *left]), "b": np.concatenate([none, *right])})

    return met


def _rest_pairs(shared: DataFrame, first: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents of different components that may be similar enough, among members of mixed buckets."""
    placed = shared.filter("members > 2").join(first, shared["doc_id"] == first["node"], "left")
    placed = placed.select("doc_id", "band", F.coalesce("component", "doc_id").alias("component"))
    ends = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = placed.join(ends.filter("low < high"), "band")
    rest = materialise(mixed.select("doc_id", "component").distinct(), "dedup-rest")
    chosen = texts.join(rest, "doc_id", "left_semi")
    details = materialise(
        chosen.mapInArrow(_details, "doc_id long, shingles array<long>, fine binary"), "dedup-details"
    )
    firsts = materialise(_first_shingles(details, percent).join(rest, "doc_id"), "dedup-firsts")

    # Shingles that meet nobody of another component make no pair; hot ones are cut in blocks.
    sizes = firsts.groupBy("shingle").agg(
        F.count_if("short").alias("n_short"),
        F.count(F.lit(1)).alias("n_long"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    sizes = sizes.filter("n_short > 0 AND low < high")
    blocks = [F.ceil(F.col(f"n_{c}") / MEETING).cast("int").alias(f"{c}s") for c in ("short", "long")]
    met = firsts.join(sizes.select("shingle", *blocks), "shingle")

    def block(parts: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(parts).cast("long")).cast("int")

    def upto(parts: str) -> Column:
        return F.sequence(F.lit(0), F.col(parts) - 1)

    def part(low: Column, high: Column, as_short: Column, as_long: bool) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), as_short.alias("as_short"), F.lit(as_long).alias("as_long"))

    shorter = F.transform(upto("longs"), lambda x: part(block("shorts"), x, F.lit(True), False))
    longer = F.transform(upto("shorts"), lambda x: part(x, block("longs"), F.lit(False), True))
    parts = (
        F.when(F.col("longs") == 1, F.array(part(F.lit(0), F.lit(0), F.col("short"), True)))
        .when(F.col("short"), F.concat(shorter, longer))
        .otherwise(longer)
    )
    met = met.withColumn("part", F.explode(parts)).join(details.select("doc_id", "fine"), "doc_id")
    met = met.select("shingle", "part.*", "doc_id", "n", "place", "component", "fine")
    pairs = met.groupBy("shingle", "low", "high").applyInArrow(_meet(percent), "a long, b long")
    return pairs.distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The component of near duplicates that every row of ``docs`` (doc_id, text) is in.

    Two documents are linked if ``100 * intersection >= percent * union`` holds
    for their sets of distinct five-word shingles (fewer words: the sequence as
    one shingle). Returns doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, its own included) and kept (doc_id = component_id).

    Null and empty texts and texts without words have no shingles and no links.
    A row with a null doc_id has a null component and is kept, for nothing can
    name it. Repeated rows are all returned, with the same values. An empty
    table gives no rows. Other columns are not read.

    Different texts under one doc_id are outside the contract: rows are linked
    by doc_id, so one of the texts may stand for all of them.
    """
    small_batches(docs.sparkSession)
    sketches = materialise(sketch(docs, bands_for(percent)), "dedup-sketches")
    wordy = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = wordy.groupBy("word_key").agg(F.min("doc_id").alias("rep"))
    reps = materialise(
        wordy.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .select("doc_id", "registers", "bands"),
        "dedup-reps",
    )
    shared, star_pairs = _candidates(reps)
    likely = materialise(_likely(star_pairs, reps, percent), "dedup-likely")
    # The texts that any step below may look at, taken out of all texts once.
    asked = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).union(
        shared.filter("members > 2").select("doc_id")
    )
    asked = materialise(asked.distinct(), "dedup-asked")
    texts = materialise(_texts_of(docs, asked), "dedup-texts")
    first = components(confirmed_links(likely, texts, percent))
    rest = materialise(_rest_pairs(shared, first, texts, percent), "dedup-rest-pairs")
    more = materialise(confirmed_links(rest, texts, percent), "dedup-more-links")
    tied = first.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more)
    final = components(tied) if not more.isEmpty() else first

    homes = classes.join(final, classes["rep"] == final["node"], "left").select(
        F.col("word_key").alias("_key"), F.coalesce("component", "rep").alias("home")
    )
    # Documents without words look for a class of their own, so that they don't meet in one task.
    own = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    wordy_key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("word_key"))
    found = sketches.withColumn("_key", F.coalesce(wordy_key, own)).join(homes, "_key", "left")
    component = F.coalesce("home", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for every component, with all its columns.

    Rows with a null doc_id stay. If rows repeat a kept doc_id, one of them stays.
    Different texts under one doc_id are outside the contract; some may be lost.
    """
    marks = materialise(near_duplicates(docs, percent).filter("doc_id IS NOT NULL"), "dedup-marks")
    # Written, their sizes are known: joins with few identifiers shuffle no documents.
    dropped = materialise(marks.filter("NOT kept").select(F.col("doc_id").alias("_id")), "dedup-dropped")
    repeated = marks.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id"))
    repeated = materialise(repeated, "dedup-repeated")
    kept = docs.join(dropped, docs["doc_id"] == F.col("_id"), "left_anti")
    single = kept.join(repeated, kept["doc_id"] == F.col("_id"), "left_anti")
    return single.union(kept.join(repeated, kept["doc_id"] == F.col("_id"), "left_semi").dropDuplicates(["doc_id"]))
