"""Small Arrow batches, so that Python workers hold few texts at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch, unless the session says otherwise.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def small_batches(spark: SparkSession) -> None:
    """Set the session's batch limits where nobody has set them."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
