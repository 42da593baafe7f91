"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import (
    alignment,
    bpe,
    fingerprints,
    licenses,
    mixing,
    neardup,
    quality,
    sharding,
    token_counts,
    toxicity,
    variants,
    vectors,
    warc,
)
from creditloom.llm.oracles import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network fitted to the labels that are not held out."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and certified verdict of every document."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every document and of their decoded text."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and slot for every document; all shards match the mixture of sources."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@_query
def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives give it back."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@_query
def op10_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@_query
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@_query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a byte-level and a sentencepiece vocabulary split every document."""
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.token_alignment(table(spark, sf_dir, "documents"), first, second)


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents and the forms that they may be variants of."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))
