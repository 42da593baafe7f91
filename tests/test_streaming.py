"""Row-wise operators run on a stream as they are."""

from pyspark.sql import functions as F

from checks.constants import FIRST
from creditloom import fixed as X
from creditloom.operators import explain, frames, scoring
from creditloom.operators.features import add_derived_features, fix_sentinel
from creditloom.operators.frames import BORROWER_COLUMNS


def score(df):
    rows = fix_sentinel(add_derived_features(df))
    scored = scoring.score(rows, {X.LOGISTIC: FIRST}).select(X.ID, "p", "risk_band")
    factors = scoring.risk_factors_long(frames.inputs_from_applications(df)).select(X.ID, F.col("factor").alias("risk_band"))
    return scored, factors, explain.attribution_long(explain.linear_attribution(rows, FIRST)).select(X.ID, "feature", "phi")


def test_stream_equals_batch(spark, tables, tmp_path):
    source = str(tmp_path / "in")
    batch = tables.applications.select(*BORROWER_COLUMNS)
    batch.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    for i, (live, still) in enumerate(zip(score(stream), score(batch))):
        query = live.writeStream.format("memory").queryName(f"live_{i}").outputMode("append").start()
        try:
            query.processAllAvailable()
            got = spark.table(f"live_{i}")
            assert got.count() == still.count()
            assert got.exceptAll(still).count() == 0
        finally:
            query.stop()
