import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside or return themselves.
CLASHING = (
    "size shard slot law taken target score toxic threshold kept component_id n_shingles n_tokens ids part role row place "
    "_row _doc _key _cell _stratum stratum n_words spans decoded"
).split()


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/labels.parquet")


def edge_rows():
    random.seed(3)
    words = ["alpha", "beta", "Gamma", "delta", "straße", "été", "日本", "x", "#1", "by"]
    long = " ".join(random.choice(words) for _ in range(30_000))
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t \x0b\x0c\r ", None, None, None),
        (4, "one two three four", "en", "b", 18),
        (5, "One TWO three four", "fr", "b", 18),
        (6, "one two three four", None, None, 18),
        (7, long, "en", "a", len(long)),
        (8, long + " tail", "en", "a", len(long) + 5),
        (9, "y" * 50_000, "de", "c", 50_000),
        (None, "a null identifier with a few words in it", "en", "a", 10),
        (None, None, None, None, None),
        (11, "the same row twice, CC BY the same row", "en", "a", 10),
        (11, "the same row twice, CC BY the same row", "en", "a", 10),
        (12, "line\nline\nline\nother\n\n", "en", "é", 10),
        (13, "á     İ ΑΣ ﬁ \x00 \U0001f600 <|endoftext|>tail <|startoftext|>", "xx", "a", 10),
        (14, "all rights reserved " * 60, "en", "a", 10),
        (15, " ".join(f"plain{i}" for i in range(80)), "en", "a", 10),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
