"""Bounds on what travels to Python workers at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch of rows, so that large files don't make batches large.
BATCH = 8_000_000


def bounded(spark: SparkSession) -> None:
    """Bounds batches by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":
        spark.conf.set(key, BATCH)
