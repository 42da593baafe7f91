"""From raw documents to token sequences, in five stages over whole tables.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next one's documents. ``ORACLE_SQL`` is None: a trained network and a
tokenizer are beyond SQL; tests hold the stages against brute force.

All stages but the last return the five columns of ``documents`` and drop any
others first, so names can't clash. Texts of any length are taken whole, and an
empty table gives no rows at every stage. What else a stage does with nulls, ties
and repeated rows is stated with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import bpe, mixing, neardup, quality, toxicity
from creditloom.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None
#: Near copies share this percent of their five-word shingles; op8's own contract says 85.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language.

    Null and empty texts fail the base. A null lang is a language of its own, a
    null doc_id has no label, repeated rows are judged alike and all stay or go.
    """
    return quality.good_documents(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds clean by their language's threshold.

    Null and empty texts have a score like any other, a null lang has the
    threshold 0.5, a null doc_id is never a label; repeated rows are judged alike.
    """
    return toxicity.clean_documents(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, of similarity 0.8 or more on five-word shingles.

    The smallest doc_id stays. Texts without words are linked with nothing, rows
    with a null doc_id stay, and of rows that repeat a kept doc_id one stays.
    """
    return neardup.deduplicated(docs.select(*COLUMNS), NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document that it takes twice is there twice.

    Documents without words are never taken. A null source is a source of its
    own; ties in the order go by hash, doc_id and size, so reruns agree.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mixed documents, as little-endian unsigned 32-bit integers in base 64, with digests.

    One row for every row; null and empty texts have no tokens, a null doc_id stays null.
    """
    encoded = bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.base64("ids").alias("ids_base64"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; null, empty and repeated rows fare as each stage says."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
