"""Registered queries and the pipeline: SQL where there is any, brute force elsewhere."""

import base64
import inspect
import struct

import pytest
from checks.compare import compare, connect
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from creditloom.llm import mixing, neardup, quality, toxicity
from creditloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small_dir):
    return connect(small_dir)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert set(ORACLE) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, small_dir, name):
    ok, note = compare(spark, duck, small_dir, name)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op13_spelling_variants"}))
def test_one_row_for_every_row(spark, small_dir, name):
    table, key = {"op9": ("pages", "page_id"), "op11": ("embeddings", "vec_id")}.get(
        name.split("_")[0], ("documents", "doc_id")
    )
    want = sorted(r[0] for r in spark.read.parquet(f"{small_dir}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in QUERIES[name](spark, small_dir).select(key).collect()) == want


@pytest.mark.parametrize("module", [quality, __import__("creditloom.llm.sharding", fromlist=["x"])])
def test_native_operators_use_no_python(module):
    source = inspect.getsource(module)
    assert not any(word in source for word in ("udf", "mapIn", "applyIn", "pandas", "pyarrow", ".rdd"))


def test_pipeline(spark, documents, labels, small_dir, vocabulary):
    """Every stage of the pipeline against its operator's verdict on the rows before it."""
    docs = documents
    kept = quality.score_quality(docs, labels).filter("kept").select("doc_id")
    after = corpus_pipeline.quality_rules(spark, docs, small_dir)
    assert after.columns == documents.columns
    assert ids(after) == ids(kept)
    docs = after
    clean = toxicity.score_toxicity(docs, labels).filter("NOT toxic").select("doc_id")
    after = corpus_pipeline.drop_toxic(spark, docs, small_dir)
    assert after.columns == documents.columns and ids(after) == ids(clean)
    docs = after
    after = corpus_pipeline.drop_near_copies(spark, docs, small_dir)
    near = neardup.near_duplicates(docs, corpus_pipeline.NEAR_PERCENT).filter("kept")
    assert after.columns == documents.columns and ids(after) == ids(near)
    docs = after
    after = corpus_pipeline.mix_sources(spark, docs, small_dir)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).filter("size > 0").collect()}
    assert after.columns == documents.columns
    assert ids(after) == sorted(i for i, n in taken.items() for _ in range(n))
    last = corpus_pipeline.encode_tokens(spark, after, small_dir)
    got = corpus_pipeline.run(spark, small_dir)
    assert got.columns == last.columns
    assert sorted(got.collect()) == sorted(last.collect())
    texts = {r["doc_id"]: r["text"] for r in after.select("doc_id", "text").collect()}
    library = Tokenizer.from_file(vocabulary)
    for r in got.collect()[:50]:
        tokens = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert base64.b64decode(r["ids_base64"]) == struct.pack(f"<{len(tokens)}I", *tokens)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_pipeline_of_an_empty_table(spark, documents, small_dir):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir)
        assert docs.count() == 0


def test_pipeline_with_edges(spark, edges, small_dir):
    """Clashing columns are left behind, nulls and repeated rows go through."""
    docs = edges
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir)
    assert docs.count() >= 0
