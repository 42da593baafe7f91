"""The classifier: held-out accuracy, whole texts, and only the text as input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import toxicity

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")


@pytest.fixture(scope="module")
def model(larger):
    return toxicity.fit(*larger)


def test_held_out_accuracy(larger):
    docs, labels = larger
    rows = toxicity.score_toxicity(docs, labels)
    assert rows.count() == docs.count()
    marked = labels.select("doc_id", F.col("toxic").alias("mark"))
    for verdict in ("predicted = 1", "toxic"):
        own = rows.filter("held_out").join(marked, "doc_id").withColumn("said", F.expr(verdict))
        found = own.agg(
            F.sum(F.expr("int(said AND mark = 1)")).alias("hit"),
            F.sum(F.expr("int(said AND mark = 0)")).alias("wrong"),
            F.sum(F.expr("int(mark = 1)")).alias("all"),
        ).first()
        assert found["hit"] >= 0.85 * found["all"]
        assert found["wrong"] <= 0.1 * (found["hit"] + found["wrong"])


def test_held_out_labels_change_nothing(spark, documents, labels):
    turned = labels.withColumn(
        "toxic", F.when(toxicity._fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    first = toxicity.score_toxicity(documents, labels).orderBy("doc_id").collect()
    assert first == toxicity.score_toxicity(documents.repartition(5), turned).orderBy("doc_id").collect()
    for r in first:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_blocks_equal_the_whole(model, monkeypatch):
    draw = np.random.default_rng(1)
    codes = toxicity.codes_of(" ".join(f"word{'abcdefgh'[i]}" for i in draw.integers(0, 8, 5000)), toxicity._Buckets())
    whole = model.responses(codes)
    for block in (1, 7, 4999, 5000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(model.responses(codes), whole, atol=1e-5)


def test_edges(edges, nothing, documents, labels, no_labels):
    both = documents.filter("doc_id > 100").unionByName(edges.select(documents.columns))
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(both, labels).collect()}
    assert rows[1]["score"] == rows[2]["score"] == rows[3]["score"]  # null, empty, white space
    assert rows[4]["score"] == rows[5]["score"] == rows[6]["score"]  # other language, source and identifier
    assert not rows[None]["held_out"]
    unlabelled = toxicity.score_toxicity(edges, no_labels).collect()
    assert len(unlabelled) == edges.count() and all(r["score"] < 0.5 for r in unlabelled)
    assert toxicity.score_toxicity(nothing, no_labels).count() == 0
    clean = toxicity.clean_documents(edges, no_labels)
    assert clean.columns == edges.columns and clean.count() == edges.count()


def test_thresholds_follow_the_language():
    settings = toxicity.Settings(fewest_positives=5)
    outputs = np.concatenate([np.linspace(-4, -2, 50), np.linspace(1, 4, 50)] * 2)
    labels = np.array([0] * 50 + [1] * 50 + [0] * 70 + [1] * 30)
    fitted = toxicity.calibrate(
        toxicity.train([], [], settings), outputs, labels, ["a"] * 100 + ["b"] * 100, 0.4, settings
    )
    assert set(fitted.thresholds) == {"a", "b"} and fitted.thresholds["a"] < fitted.thresholds["b"]
    assert all(settings.lowest <= t <= settings.highest for t in fitted.thresholds.values())


def plain_responses(embeddings, kernels, biases, codes):
    """Position by position, filter by filter: the convolution as it is defined, with two empty words at the end."""
    words = [*codes.tolist(), *[0] * (max(toxicity.WIDTHS) - 1)]
    vectors = [embeddings[c >> 32].astype(float) + embeddings[c & 0xFFFFFFFF] for c in words]
    out = []
    for kernel in kernels:
        for f in range(kernel.shape[2]):
            places = range(max(len(codes), 1))
            out.append(max(sum(float(vectors[i + j] @ kernel[j, :, f]) for j in range(len(kernel))) for i in places))
    return np.maximum(np.array(out) + biases, 0)


def some_codes(seed, lengths):
    draw, buckets = np.random.default_rng(seed), toxicity._Buckets()
    return [toxicity.codes_of(" ".join(f"w{'abcdefghij'[i]}rd" for i in draw.integers(0, 10, n)), buckets) for n in lengths]


def test_scores_equal_a_plain_convolution():
    settings = toxicity.Settings(rate=0.05, epochs=3, fewest_steps=1)
    codes = some_codes(2, (12, 1, 2, 3, 40, 5, 9, 17))
    model = toxicity.train(codes, [0, 1] * 4, settings)
    model.slope, model.offset = 1.7, -0.3
    for c in codes:
        want = plain_responses(model.embeddings, model.kernels, model.biases, c)
        assert np.allclose(model.responses(c), want, atol=1e-4)
        output = float(want @ model.weights) + model.bias
        assert model.score(c) == pytest.approx(1 / (1 + np.exp(-(1.7 * output - 0.3))), abs=1e-5)


def test_gradients_equal_finite_differences():
    """The first step of training, undone to gradients, against differences of the plain loss in every group of parameters."""
    labels = np.array([0, 1, 1, 0, 1])
    codes = some_codes(5, (7, 4, 11, 6, 9))
    still = dict(epochs=1, fewest_steps=1, batch=len(labels), word_dropout=0.0, decay=0.0, dimensions=6, filters=4)
    start = toxicity.train(codes, labels, toxicity.Settings(rate=0.0, **still))
    moved = toxicity.train(codes, labels, toxicity.Settings(rate=1.0, **still))
    pull = np.where(labels == 1, 5 / (2 * 3), 5 / (2 * 2))

    def loss(embeddings, kernels, biases, weights, bias):
        total = 0.0
        for c, y, w in zip(codes, labels, pull, strict=True):
            z = float(plain_responses(embeddings, kernels, biases, c) @ weights) + bias
            total += w * (np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z)))
        return total / len(labels)

    def parts(model):
        return [model.embeddings.astype(float), *(k.astype(float) for k in model.kernels), model.biases.astype(float), model.weights.astype(float)]

    def of(values, bias=0.0):
        return loss(values[0], values[1 : 1 + len(toxicity.WIDTHS)], values[-2], values[-1], bias)

    before, after = parts(start), parts(moved)
    draw, step = np.random.default_rng(0), 1e-5
    used = sorted({int(x) for c in codes for x in (*(c >> 32), *(c & 0xFFFFFFFF))} - {0})
    checked = 0
    for n, (old, new) in enumerate(zip(before, after, strict=True)):
        unit = new - old
        if n == 0:
            share = (unit**2).mean(axis=1, keepdims=True)
            grad = -unit * np.sqrt(1e-3 + 1e-3 * share / (1 - share))
            places = [(r, int(draw.integers(0, old.shape[1]))) for r in draw.choice(used, 12)]
        else:
            grad = -unit * np.sqrt(1e-2 / (1 - unit**2))
            places = [tuple(int(draw.integers(0, s)) for s in old.shape) for _ in range(12)]
        for place in places:
            differences = []
            for sign in (1, -1):
                values = [p.copy() for p in before]
                values[n][place] += sign * step
                differences.append(sign * of(values))
            exact = sum(differences) / (2 * step)
            assert grad[place] == pytest.approx(exact, rel=0.02, abs=2e-5), (n, place)
            checked += abs(exact) > 1e-4
    assert checked > 20
    # The step of the bias alone: Adagrad adds to a sum of 0.01.
    exact = (of(before, step) - of(before, -step)) / (2 * step)
    assert -moved.bias == pytest.approx(exact / np.sqrt(1e-2 + exact**2), rel=0.02, abs=1e-4)


def test_every_label_is_learned(spark):
    """Two words mark toxic texts; one of them comes only in the documents that are last by hash."""
    ids = spark.range(14_000).filter(toxicity._fold(F.col("id")) != 0).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    hashes = sorted(r[0] for r in ids.filter("toxic = 1").select(F.xxhash64("doc_id")).collect())
    late = F.xxhash64("doc_id") > hashes[4000]
    word = F.when(F.col("toxic") == 0, "kind").when(late, "vile").otherwise("nasty")
    docs = ids.select("doc_id", F.concat(F.lit("some "), word, F.lit(" text")).alias("text"), F.lit("en").alias("lang"))
    asked = spark.createDataFrame([(-1, "some vile text", "en"), (-2, "some nasty text", "en"), (-3, "some kind text", "en")], docs.schema)
    for shard in (24_000_000, 60_000):
        model = toxicity.fit(docs, ids, toxicity.Settings(shard=shard, epochs=4))
        scored = {r["doc_id"]: model.score(toxicity.codes_of(r["text"], toxicity._Buckets())) for r in asked.collect()}
        assert scored[-1] > 0.8 and scored[-2] > 0.8 and scored[-3] < 0.2


def test_shards_depend_on_the_rows_alone(larger):
    docs, labels = larger
    settings = toxicity.Settings(shard=2_000_000, epochs=3)
    one, other = toxicity.fit(docs, labels, settings), toxicity.fit(docs.repartition(7).union(docs), labels.repartition(3), settings)
    assert np.array_equal(one.embeddings, other.embeddings) and one.thresholds == other.thresholds
    assert (one.slope, one.offset, one.bias) == (other.slope, other.offset, other.bias)


def test_training_in_blocks_equals_the_whole(monkeypatch):
    codes, settings = some_codes(4, (40, 3, 0, 25, 90, 7)), toxicity.Settings(epochs=3, fewest_steps=1)
    whole = toxicity.train(codes, [0, 1] * 3, settings)
    for block in (1, 8, 33):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        cut = toxicity.train(codes, [0, 1] * 3, settings)
        assert np.allclose(cut.embeddings, whole.embeddings, atol=1e-4) and np.allclose(cut.weights, whole.weights, atol=1e-4)


def test_calibration_over_rows_equals_that_in_numpy(spark):
    draw, settings = np.random.default_rng(8), toxicity.Settings(fewest_positives=30)
    rows = []
    for lang, n, shift in (("a", 500, 0.0), ("b", 400, 1.5), ("c", 40, 0.0), ("", 200, 0.0), (None, 100, 0.0)):
        for _ in range(n):
            toxic = int(draw.random() < 0.3)
            rows.append((lang, round(float(draw.normal(2 * toxic - 1 + shift, 1.0)), 2), toxic))
    langs, outputs, labels = zip(*rows, strict=True)
    empty = toxicity.train([], [], settings)
    plain = toxicity.calibrate(empty, np.array(outputs), np.array(labels), langs, 0.2, settings)
    a, b, cuts = plain.slope, plain.offset, dict(plain.thresholds)
    table = spark.createDataFrame(rows, "lang string, output double, toxic int").repartition(5)
    found = toxicity.calibrate_rows(toxicity.train([], [], settings), table, 0.2, settings)
    assert set(cuts) == {"a", "b"} and found.thresholds == pytest.approx(cuts, abs=1e-7)
    assert (found.slope, found.offset) == pytest.approx((a, b), abs=1e-7)


def test_packed_codes_come_back():
    codes = toxicity.codes_of(" ".join(f"word{'abcdefghijklmnop'[i % 16]}{'xyz'[i % 3]}" for i in range(500)), toxicity._Buckets())
    most = np.array([toxicity.WORD_BUCKETS << 32 | (toxicity.WORD_BUCKETS + toxicity.STEM_BUCKETS), 1 << 32 | (1 + toxicity.WORD_BUCKETS)])
    for c in (codes, most, codes[:0]):
        raw = toxicity.packed(c)
        assert len(raw) == 4 * len(c) and np.array_equal(toxicity.unpacked(raw), c)


def test_texts_are_never_joined(documents, labels, monkeypatch):
    """Codes and outputs meet the labels; a join of texts would shuffle them whole once the labels are many."""
    frames = []

    def noted(name, place):
        plain = getattr(toxicity, name)

        def call(*args):
            frames.append(args[place])
            return plain(*args)

        monkeypatch.setattr(toxicity, name, call)

    noted("_train_shards", 0)
    noted("calibrate_rows", 1)
    toxicity.fit(documents, labels, toxicity.Settings(epochs=1, fewest_steps=1))
    joins = []

    def look(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joins.append([child.output().apply(i).name() for child in below for i in range(child.output().size())])
        for child in below:
            look(child)

    for frame in frames:
        look(frame._jdf.queryExecution().optimizedPlan())
    assert len(frames) == 2 and joins and not any("text" in names for names in joins)


def test_shards_hold_four_bytes_a_word(spark, monkeypatch):
    """An executor keeps the shards for all rounds; unlabelled texts and labels without text are not in them."""
    docs = spark.createDataFrame([(i, f"one two three number{'ab'[i % 2]}", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 60)], "doc_id long, toxic int")
    plain, rows = toxicity._train_shards, []

    def noted(codes, *rest):
        rows.extend(codes.select("doc_id", F.length("codes").alias("bytes")).collect())
        return plain(codes, *rest)

    monkeypatch.setattr(toxicity, "_train_shards", noted)
    toxicity.fit(docs, labels, toxicity.Settings(epochs=1, fewest_steps=1))
    learned = [i for i in range(20, 40) if zlib.crc32(str(i).encode()) % 5 not in (toxicity.HELD_OUT, toxicity.CALIBRATION)]
    assert sorted(r["doc_id"] for r in rows) == learned and {r["bytes"] for r in rows} == {16}
