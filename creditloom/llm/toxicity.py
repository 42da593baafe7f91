"""A convolutional text classifier for toxicity.

A word is the sum of two hashed embeddings, of the word and of its first four
letters, so that inflected and compounded forms share what they learn. Filters
of several widths slide over the words, each keeps its largest response in the
text (max pooling), and a linear layer weighs the responses. The network is
trained in numpy on all labelled documents, dealt out to shards of bounded size:
every round each shard goes on from the common network, and what they learned is
averaged. A held-back fold of the labels turns its output into a probability and
finds a threshold for every language.

Max pooling lets a text of any length be learned and scored whole in blocks: the
pooled responses of a text are the largest of its blocks'.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.batches import small_batches
from creditloom.operators.ranking import running_totals
from creditloom.session import discard, materialise

WORD = re.compile(r"[^\W\d_]+")
WORD_BUCKETS, STEM_BUCKETS, STEM = 1 << 15, 1 << 13, 4
WIDTHS = (1, 2, 3)
#: Words that a scoring step handles at once.
BLOCK = 1 << 15
_REMEMBERED = 1 << 17
#: Labels with this remainder of crc32(doc_id) by 5 are never used.
HELD_OUT, CALIBRATION, FOLDS = 0, 1, 5


@dataclass(frozen=True)
class Settings:
    """The size of a shard, in bytes of text, and the bounds of the network."""

    shard: int = 24_000_000
    dimensions: int = 16
    filters: int = 16
    epochs: int = 8
    fewest_steps: int = 300
    batch: int = 32
    rate: float = 0.05
    word_dropout: float = 0.2
    decay: float = 1e-4
    fewest_positives: int = 20
    lowest: float = 0.2
    highest: float = 0.8
    seed: int = 7


class _Buckets(dict):
    """Word to its two embedding rows, packed in one number; row 0 is padding."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        whole = zlib.crc32(word.encode()) % WORD_BUCKETS
        stem = zlib.crc32(b"^" + word[:STEM].encode()) % STEM_BUCKETS
        value = self[word] = (1 + whole) << 32 | (1 + WORD_BUCKETS + stem)
        return value


def codes_of(text: str | None, buckets: dict[str, int]) -> np.ndarray:
    """The embedding rows of the words of a whole text."""
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))


def packed(codes: np.ndarray) -> bytes:
    """The codes of a text in four bytes each, to be shuffled and stored."""
    return (((codes >> 32) - 1) * STEM_BUCKETS + ((codes & 0xFFFFFFFF) - 1 - WORD_BUCKETS)).astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    whole, stem = np.divmod(np.frombuffer(raw, "<u4").astype(np.int64), STEM_BUCKETS)
    return (1 + whole) << 32 | (1 + WORD_BUCKETS + stem)


@dataclass
class Model:
    """The network, its calibration and the thresholds of the languages."""

    embeddings: np.ndarray
    kernels: list[np.ndarray]
    biases: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, codes: np.ndarray) -> np.ndarray:
        """The pooled responses of the filters to a text, block by block."""
        reach = max(WIDTHS) - 1
        best = np.full(len(self.weights), -np.inf, np.float32)
        for start in range(0, max(len(codes), 1), BLOCK):
            block = codes[start : start + BLOCK + reach]
            block = np.concatenate([block, np.zeros(max(min(len(codes) - start, BLOCK), 1) + reach - len(block), np.int64)])
            vectors = self.embeddings[block >> 32] + self.embeddings[block & 0xFFFFFFFF]
            places = len(block) - reach
            found = [
                sum(vectors[j : j + places] @ kernel[j] for j in range(len(kernel))).max(axis=0) for kernel in self.kernels
            ]
            best = np.maximum(best, np.concatenate(found))
        return np.maximum(best + self.biases, 0)

    def output(self, codes: np.ndarray) -> float:
        return float(self.responses(codes) @ self.weights) + self.bias

    def score(self, codes: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.output(codes) + self.offset, -40, 40))))


@dataclass
class _Learner:
    """A network in training: the model with the sums of squared gradients that Adagrad keeps."""

    model: Model
    sums: list[np.ndarray]
    row_sums: np.ndarray
    bias_sum: float

    def parts(self) -> list[np.ndarray]:
        """What every step changes; of the embeddings only a few rows change."""
        return [*self.model.kernels, self.model.biases, self.model.weights]


def _learner(settings: Settings, random: np.random.Generator) -> _Learner:
    rows, d, f = 1 + WORD_BUCKETS + STEM_BUCKETS, settings.dimensions, settings.filters
    model = Model(
        # Small, so that words never seen in training hardly respond.
        random.normal(0, 0.01, (rows, d)).astype(np.float32),
        [random.normal(0, (k * d) ** -0.5, (k, d, f)).astype(np.float32) for k in WIDTHS],
        np.zeros(len(WIDTHS) * f, np.float32),
        random.normal(0, 0.3, len(WIDTHS) * f).astype(np.float32),
        0.0,
    )
    model.embeddings[0] = 0
    learner = _Learner(model, [], np.full(rows, 1e-3, np.float32), 1e-2)
    learner.sums = [np.full_like(p, 1e-2) for p in learner.parts()]
    return learner


def _constant(model: Model, positives: int) -> Model:
    """The model where the labels have one class, or there are none."""
    model.weights[:] = 0
    model.bias = 4.0 if positives else -4.0
    return model


def _epochs(rows: int, settings: Settings) -> int:
    return max(settings.epochs, -(-settings.fewest_steps * settings.batch // rows))


def _peaks(model: Model, packed: np.ndarray, spans: Sequence[tuple[int, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Where in its span every filter responds most and how much, by kernel; about ``BLOCK`` places at a time."""
    reach, f = max(WIDTHS) - 1, model.kernels[0].shape[2]
    peaks = [np.zeros((len(spans), f), np.int64) for _ in model.kernels]
    tops = [np.full((len(spans), f), -np.inf, np.float32) for _ in model.kernels]
    pieces = [(i, a, min(a + BLOCK, e)) for i, (s, e) in enumerate(spans) for a in range(s, e, BLOCK)]
    at = 0
    while at < len(pieces):
        base, until = pieces[at][1], at + 1
        while until < len(pieces) and pieces[until][2] - base <= BLOCK:
            until += 1
        words = packed[base : pieces[until - 1][2] + reach]
        vectors = model.embeddings[words >> 32] + model.embeddings[words & 0xFFFFFFFF]
        places = len(words) - reach
        for kernel, peak, top in zip(model.kernels, peaks, tops, strict=True):
            z = sum(vectors[j : j + places] @ kernel[j] for j in range(len(kernel)))
            for i, s, e in pieces[at:until]:
                own = z[s - base : e - base]
                best = own.argmax(axis=0)
                found = own[best, np.arange(f)]
                better = found > top[i]
                peak[i][better], top[i][better] = (s + best)[better], found[better]
        at = until
    return peaks, tops


def _learn(
    learner: _Learner,
    texts: Sequence[np.ndarray],
    y: np.ndarray,
    pulls: tuple[float, float],
    epochs: range,
    of: int,
    settings: Settings,
    random: np.random.Generator,
) -> None:
    """Some of the epochs over the texts; ``pulls`` are the weights of the two classes."""
    model, d, f, reach = learner.model, settings.dimensions, settings.filters, max(WIDTHS) - 1
    parts, pads = learner.parts(), np.zeros(reach, np.int64)
    pull = np.where(y == 1, pulls[1], pulls[0])
    for epoch in epochs:
        rate = settings.rate * (1 - epoch / of)
        for chosen in np.array_split(random.permutation(len(y)), max(1, len(y) // settings.batch)):
            pieces, spans, at = [], [], 0
            for i in chosen:
                codes = texts[i]
                if len(codes) > 4:
                    codes = codes[random.random(len(codes)) >= settings.word_dropout]
                if len(codes) == 0:
                    codes = np.zeros(1, np.int64)
                spans.append((at, at + len(codes)))
                pieces += [codes, pads]
                at += len(codes) + reach
            packed = np.concatenate(pieces)
            peaks, tops = _peaks(model, packed, spans)
            pooled = np.concatenate(tops, axis=1) + model.biases
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.weights + model.bias, -30, 30)))
            slope = ((p - y[chosen]) * pull[chosen] / len(chosen)).astype(np.float32)
            back = slope[:, None] * model.weights * (pooled > 0)
            grads, touched, flows = [], [], []
            for n, (kernel, peak) in enumerate(zip(model.kernels, peaks, strict=True)):
                own = back[:, n * f : (n + 1) * f]
                grad = np.empty_like(kernel)
                for j in range(len(kernel)):
                    whole, stem = packed[peak + j] >> 32, packed[peak + j] & 0xFFFFFFFF
                    grad[j] = np.einsum("bfd,bf->df", model.embeddings[whole] + model.embeddings[stem], own)
                    flow = (own[:, :, None] * kernel[j].T[None]).reshape(-1, d)
                    touched += [whole.ravel(), stem.ravel()]
                    flows += [flow, flow]
                grads.append(grad + settings.decay * kernel)
            grads += [back.sum(axis=0), slope @ active + settings.decay * model.weights]
            for part, grad, total in zip(parts, grads, learner.sums, strict=True):
                total += grad * grad
                part -= rate * grad / np.sqrt(total)
            # Of the embeddings only the rows at the peaks change.
            index = np.concatenate(touched)
            order = np.argsort(index, kind="stable")
            found, starts = np.unique(index[order], return_index=True)
            grad = np.add.reduceat(np.concatenate(flows)[order], starts)
            learner.row_sums[found] += (grad * grad).mean(axis=1)
            model.embeddings[found] -= rate * grad / np.sqrt(learner.row_sums[found])[:, None]
            model.embeddings[0] = 0
            learner.bias_sum += float(slope.sum()) ** 2
            model.bias -= rate * float(slope.sum()) / learner.bias_sum**0.5


def _pulls(rows: int, positives: int) -> tuple[float, float]:
    """The weights of the classes, which make both weigh the same."""
    return rows / (2 * (rows - positives)), rows / (2 * positives)


def train(texts: Sequence[np.ndarray], labels: Sequence[int], settings: Settings) -> Model:
    """Fit the network with weighted logistic loss, Adagrad and word dropout, all texts in one shard."""
    random = np.random.default_rng(settings.seed)
    learner = _learner(settings, random)
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return _constant(learner.model, int(len(y) and y.min() == 1))
    epochs = _epochs(len(y), settings)
    _learn(learner, texts, y, _pulls(len(y), y.sum()), range(epochs), epochs, settings, random)
    return learner.model


#: Embedding rows of a block in which shards report what they learned; block -1 is the rest of the network.
_ROWS = 1024


def _flat(learner: _Learner) -> np.ndarray:
    """All that is not an embedding, in one row of numbers."""
    ends = [np.array([learner.model.bias, learner.bias_sum])]
    return np.concatenate([*(p.ravel() for p in learner.parts()), *(t.ravel() for t in learner.sums), *ends]).astype(float)


def _shard(
    learner: _Learner, pulls: tuple[float, float], epochs: range, of: int, settings: Settings, alone: np.random.Generator | None
):
    """Some epochs over the rows of a partition, which is a shard; returns the changes by blocks.

    A shard that is ``alone`` draws from the given numbers, and its changes are exact.
    """

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple, bytes] = {}
        for batch in batches:
            for *key, raw in zip(*(batch.column(c).to_pylist() for c in ("mix", "doc_id", "toxic", "codes")), strict=True):
                codes = unpacked(raw).tobytes()
                # Of repeated rows one is learned, always the same.
                rows[tuple(key)] = min(rows.get(tuple(key), codes), codes)
        if not rows:
            return
        order = sorted(rows)
        texts = [np.frombuffer(rows[key], np.int64) for key in order]
        y = np.array([toxic for _, _, toxic in order], np.float32)
        shard = TaskContext.get().partitionId()
        embeddings, sums, flat = learner.model.embeddings.copy(), learner.row_sums.copy(), _flat(learner)
        random = alone or np.random.default_rng([settings.seed, shard, epochs.start])
        _learn(learner, texts, y, pulls, epochs, of, settings, random)
        changed = np.flatnonzero(learner.row_sums != sums)
        after, before = ((e[changed].astype(float), s[changed]) for e, s in ((learner.model.embeddings, learner.row_sums), (embeddings, sums)))
        moves = (np.column_stack(after) - np.column_stack(before)).astype(float if alone else np.float32)
        found = [(-1, b"", (_flat(learner) - flat).tobytes())]
        for block in np.unique(changed // _ROWS):
            own = changed // _ROWS == block
            found.append((int(block), changed[own].tobytes(), moves[own].tobytes()))
        blocks, places, values = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([shard] * len(found), pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            names=["block", "shard", "places", "moves"],
        )

    return learned


def _mean_moves(exact: bool):
    """The mean change of a block: of every number over the shards, of an embedding over those that met its word."""

    def mean(table: pa.Table) -> pa.Table:
        block, width = table.column("block")[0].as_py(), None
        total = count = None
        for r in table.sort_by("shard").select(["places", "moves"]).to_pylist():
            if block < 0:
                places, moves = slice(None), np.frombuffer(r["moves"], float)[None]
            else:
                places = np.frombuffer(r["places"], np.int64) - block * _ROWS
                moves = np.frombuffer(r["moves"], float if exact else np.float32).reshape(len(places), -1)
            if total is None:
                width = moves.shape[1]
                total, count = np.zeros((1 if block < 0 else _ROWS, width)), np.zeros((1 if block < 0 else _ROWS, 1))
            total[places] += moves
            count[places] += 1
        return pa.table({"block": pa.array([block], pa.int32()), "moves": [(total / np.maximum(count, 1)).tobytes()]})

    return mean


def _move(learner: _Learner, moves: Mapping[int, bytes]) -> None:
    """Add the mean changes of all shards to the common network."""
    for block, raw in sorted(moves.items()):
        if block >= 0:
            own = slice(block * _ROWS, min((block + 1) * _ROWS, len(learner.row_sums)))
            change = np.frombuffer(raw, float).reshape(_ROWS, -1)[: own.stop - own.start]
            learner.model.embeddings[own] = learner.model.embeddings[own] + change[:, :-1]
            learner.row_sums[own] = learner.row_sums[own] + change[:, -1]
            continue
        change, at = np.frombuffer(raw, float), 0
        for part in (*learner.parts(), *learner.sums):
            part[...] = part + change[at : at + part.size].reshape(part.shape)
            at += part.size
        learner.model.bias += float(change[at])
        learner.bias_sum += float(change[at + 1])


def _train_shards(codes: DataFrame, rows: int, positives: int, several: bool, settings: Settings) -> Model:
    """``train`` over all rows of ``codes`` (mix, doc_id, toxic, codes), whose partitions are the shards.

    Every round, all shards go through some epochs from the same network, and
    their changes are averaged; the network alone reaches the driver. A single
    shard has one round. The rows are dealt out by document, so that a shard
    depends on its rows alone.
    """
    random = np.random.default_rng(settings.seed)
    learner = _learner(settings, random)
    if positives in (0, rows):
        return _constant(learner.model, positives)
    epochs = _epochs(rows, settings)
    rounds = min(settings.epochs, epochs) if several else 1
    cuts = [r * epochs // rounds for r in range(rounds + 1)]
    dealt = codes.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for first, last in zip(cuts, cuts[1:], strict=False):
            step = _shard(learner, _pulls(rows, positives), range(first, last), epochs, settings, None if several else random)
            changes = dealt.mapInArrow(step, "block int, shard int, places binary, moves binary")
            means = changes.groupBy("block").applyInArrow(_mean_moves(not several), "block int, moves binary").collect()
            _move(learner, {r["block"]: r["moves"] for r in means})
    finally:
        dealt.unpersist()
    return learner.model


def _scale(model: Model, sums: Callable[[float, float], Sequence[float]]) -> None:
    """Fit the slope and offset by Newton's method.

    ``sums(a, b)`` are those of the gradient and of the curvature over all rows:
    error times output, error, curve times squared output, curve times output, curve.
    """
    a, b = 1.0, 0.0
    for _ in range(100):
        go, g, coo, co, c = sums(a, b)
        step = np.linalg.solve(np.array([[coo + 1e-3, co], [co, c + 1e-6]]), np.array([go + 1e-3 * (a - 1), g]))
        a, b = max(a - np.clip(step[0], -1, 1), 0.05), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    # Sums depend in their last digits on the order in which tasks end.
    model.slope, model.offset = round(float(a), 9), round(float(b), 9)


def _class_weights(n: int, positives: int, prior: float) -> tuple[float, float]:
    """What rows of the two classes weigh, so that the share of positives is ``prior``."""
    if positives in (0, n):
        return 1.0, 1.0
    return (1 - prior) / (1 - positives / n), prior / (positives / n)


def _goals(n: int, positives: int) -> tuple[float, float]:
    return 1 / (n - positives + 2), (positives + 1) / (positives + 2)


def _bounded(threshold: float, settings: Settings) -> float:
    return min(max(threshold, settings.lowest), settings.highest)


def calibrate(
    model: Model, outputs: np.ndarray, labels: np.ndarray, langs: Sequence[str | None], prior: float, settings: Settings
) -> Model:
    """Fit the logistic scale of the outputs, then a threshold for every language.

    The rows' classes are weighted back to the share ``prior`` of all labels.
    A language with few positives keeps 0.5; ties go to the middle of the gap
    that is nearest to it, and no threshold leaves the bounds of the settings.
    ``calibrate_rows`` does the same over a table.
    """
    y = labels.astype(float)
    n, positives = len(y), int(y.sum())
    weight = np.where(y == 1, *reversed(_class_weights(n, positives, prior)))
    if 0 < positives < n:
        goal = np.where(y == 1, *reversed(_goals(n, positives)))

        def sums(a: float, b: float) -> list[float]:
            p = 1 / (1 + np.exp(-np.clip(a * outputs + b, -30, 30)))
            curve, error = weight * p * (1 - p) + 1e-9, weight * (p - goal)
            return [x.sum() for x in (error * outputs, error, curve * outputs**2, curve * outputs, curve)]

        _scale(model, sums)
    scores = 1 / (1 + np.exp(-np.clip(model.slope * outputs + model.offset, -40, 40)))
    names = np.array([x or "" for x in langs], object)
    for lang in sorted(set(langs) - {None}):
        own = names == lang
        if not lang or y[own].sum() < settings.fewest_positives:
            continue
        order = np.argsort(-scores[own], kind="stable")
        s, hit, w = scores[own][order], y[own][order], weight[own][order]
        found, wrong = np.cumsum(hit * w), np.cumsum((1 - hit) * w)
        f1 = 2 * found / (found + wrong + (hit * w).sum())
        cuts = (s + np.append(s[1:], 0)) / 2
        # Equal scores are counted together.
        last = s > np.append(s[1:], -1)
        best = np.flatnonzero((f1 >= f1[last].max() - 1e-9) & last)
        nearest = float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])
        model.thresholds[lang] = _bounded(nearest, settings)
    return model


def calibrate_rows(model: Model, rows: DataFrame, prior: float, settings: Settings) -> Model:
    """``calibrate`` over all ``rows`` (output, toxic, lang): sums, running totals and a few candidates by language reach the driver."""
    is_hit = F.col("toxic") == 1
    cells = materialise(
        rows.groupBy("lang", "output").agg(F.count_if(is_hit).alias("pos"), F.count_if(~is_hit).alias("neg")), "toxicity-outputs"
    )
    try:
        whole = cells.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
        positives = whole["pos"] or 0
        n = positives + (whole["neg"] or 0)
        weights, goals = _class_weights(n, positives, prior), _goals(n, positives)
        if 0 < positives < n:

            def sums(a: float, b: float) -> list[float]:
                out = F.col("output")
                p = 1 / (1 + F.exp(-F.greatest(F.least(out * a + b, F.lit(30.0)), F.lit(-30.0))))
                error = F.col("neg") * (weights[0] * (p - goals[0])) + F.col("pos") * (weights[1] * (p - goals[1]))
                each = F.col("neg") * (weights[0] * p * (1 - p) + 1e-9) + F.col("pos") * (weights[1] * p * (1 - p) + 1e-9)
                return list(cells.agg(*map(F.sum, (error * out, error, each * out * out, each * out, each))).first())

            _scale(model, sums)
        model.thresholds.update(_thresholds(model, cells, weights, settings))
    finally:
        discard(cells)
    return model


def _thresholds(model: Model, cells: DataFrame, weights: tuple[float, float], settings: Settings) -> dict[str, float]:
    """The threshold of every language with enough positives.

    A cut lies between a score and the next lower one, so it rises with the
    score: the cut nearest to 0.5 is that of the best score below 0.5, or of
    one of the two best ones from there on.
    """
    named = cells.filter((F.col("lang") != "") & F.col("lang").isNotNull())
    many = named.groupBy("lang").agg(F.sum("pos").alias("hits")).filter(F.col("hits") >= settings.fewest_positives)
    hits = {r["lang"]: r["hits"] for r in many.collect()}
    if not hits:
        return {}
    score = 1 / (1 + F.exp(-F.greatest(F.least(F.col("output") * model.slope + model.offset, F.lit(40.0)), F.lit(-40.0))))
    scores = named.filter(F.col("lang").isin(*hits)).groupBy("lang", score.alias("score"))
    # From the highest score down.
    scores = materialise(
        scores.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("down", -F.col("score")), "toxicity-scores"
    )
    summed = running_totals(scores, "down", ["pos", "neg"], ["lang"])
    all_hits = F.create_map(*[F.lit(x) for pair in hits.items() for x in pair])[F.col("lang")]
    found, wrong = F.col("pos_upto") * weights[1], F.col("neg_upto") * weights[0]
    summed = materialise(
        summed.select("lang", "score", (2 * found / (found + wrong + all_hits * weights[1])).alias("f1")), "toxicity-cuts"
    )
    try:
        tops = summed.groupBy("lang").agg(F.max("f1").alias("most"))
        best = summed.join(F.broadcast(tops), "lang").filter(F.col("f1") >= F.col("most") - 1e-9)
        low, high = F.max(F.when(F.col("score") < 0.5, F.col("score"))), F.min(F.when(F.col("score") >= 0.5, F.col("score")))
        ends = best.groupBy("lang").agg(low.alias("low"), high.alias("high"))
        second = F.min(F.when(F.col("score") > F.col("high"), F.col("score")))
        chosen = best.join(F.broadcast(ends), "lang").groupBy("lang", "low", "high").agg(second.alias("second")).collect()
        candidates = [(r["lang"], r[c]) for r in chosen for c in ("second", "high", "low") if r[c] is not None]
        asked = cells.sparkSession.createDataFrame(candidates, "lang string, s double")
        lower = F.max(F.when(F.col("score") < F.col("s"), F.col("score")))
        cuts = summed.join(F.broadcast(asked), "lang").groupBy("lang", "s").agg(lower.alias("lower")).collect()
    finally:
        discard(scores)
        discard(summed)
    out = {}
    for lang in sorted(hits):
        own = sorted(((r["s"] + (r["lower"] or 0.0)) / 2 for r in cuts if r["lang"] == lang), reverse=True)
        out[lang] = _bounded(min(own, key=lambda cut: abs(cut - 0.5)), settings)
    return out


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = _Buckets()
    for batch in batches:
        codes = [packed(codes_of(x.as_py(), buckets)) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.binary())], names=["doc_id", "codes"])


def _outputs(model: Model):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            outputs = [model.output(codes_of(x.as_py(), buckets)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "lang")), pa.array(outputs, pa.float64())],
                names=["doc_id", "lang", "output"],
            )

    return found


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learn from all labels (doc_id, toxic) of ``docs`` (doc_id, text, lang).

    Labels whose document is held out are left out, null labels too. Every other
    labelled text is read whole: one fold calibrates, the rest is learned, in as
    many shards as its bytes need. Of rows that repeat a document and label one
    counts. The network, sums and candidates for thresholds reach the driver.
    """
    settings = settings or Settings()
    small_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"), _fold(F.col("doc_id")).alias("fold"))
    usable = usable.filter(F.col("toxic").isin(0, 1) & (F.col("fold") != HELD_OUT)).withColumn("mix", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    usable = usable.distinct()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learned = ~_fold(F.col("doc_id")).isin(HELD_OUT, CALIBRATION)
    own, marks = texts.filter(learned), usable.filter(learned).select("doc_id", "toxic", "mix")
    sizes = own.select("doc_id", F.octet_length("text").alias("size")).join(marks, "doc_id")
    size = (
        sizes.groupBy("doc_id", "toxic")
        .agg(F.max("size").alias("size"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("toxic") == 1).alias("positives"), F.sum("size").alias("bytes"))
        .first()
    )
    shards = max(1, -(-(size["bytes"] or 0) // settings.shard))
    # What meets the labels are codes, shorter than texts; merged at any size, so that what is shuffled follows the input.
    codes = own.select("doc_id", "text").mapInArrow(_encode, "doc_id long, codes binary").join(marks.hint("merge"), "doc_id")
    codes = codes.select("mix", "doc_id", "toxic", "codes").repartition(shards, "doc_id")
    model = _train_shards(codes, size["rows"], size["positives"], shards > 1, settings)
    # Here it is outputs that meet the labels.
    held = texts.filter(_fold(F.col("doc_id")) == CALIBRATION).select("doc_id", "lang", "text")
    outputs = held.mapInArrow(_outputs(model), "doc_id long, lang string, output double")
    outputs = outputs.join(usable.select("doc_id", "toxic"), "doc_id")
    # Of repeated rows one counts, always the same.
    outputs = outputs.groupBy("doc_id", "toxic").agg(F.min(F.struct("output", "lang")).alias("row")).select("toxic", "row.*")
    return calibrate_rows(model, outputs, counts.get(1, 0) / max(1, sum(counts.values())), settings)


def _scored(model: Model, inside: str | None = None):
    """Adds the score to every column but the text, which may be a field of the column ``inside``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            texts = batch.column("text") if inside is None else pc.struct_field(batch.column(inside), "text")
            scores = [model.score(codes_of(x.as_py(), buckets)) for x in texts]
            rest = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in rest), pa.array(scores, pa.float64())], names=[*rest, "score"]
            )

    return scored


def _with_verdict(scored: DataFrame, model: Model, lang: Column) -> DataFrame:
    limit = F.lit(0.5)
    for name, value in model.thresholds.items():
        limit = F.when(lang == name, F.lit(value)).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text, lang) by a model fitted to ``labels``.

    Returns doc_id, lang, held_out, score (from the text alone), predicted (score
    at least 0.5), threshold (of the language) and toxic (score at least the
    threshold). Null and empty texts get the score of a text without words; a
    null or rare lang has the threshold 0.5; a null doc_id is not held out and
    has no label. Without usable labels every score is low. Repeated rows score
    alike. An empty table gives no rows. Other columns are not read.
    """
    model = fit(docs, labels, settings)
    thin = docs.select(F.col("text").cast("string").alias("text"), "doc_id", F.col("lang").cast("string").alias("lang"))
    found = thin.mapInArrow(_scored(model), "doc_id long, lang string, score double")
    return _with_verdict(found, model, F.col("lang")).select(
        "doc_id",
        "lang",
        F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


def clean_documents(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that are not toxic by their language's threshold, with all columns.

    The columns travel in one struct, so their names can't clash.
    """
    model = fit(docs, labels, settings)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = packed.select("doc").schema.add("score", "double")
    found = _with_verdict(packed.mapInArrow(_scored(model, "doc"), schema), model, F.col("doc.lang"))
    return found.filter(~F.col("toxic")).select("doc.*")
