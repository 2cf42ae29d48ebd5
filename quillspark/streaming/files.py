"""Folders of documents as streams. Documents don't depend on each other, so each batch runs the same plan as a table would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """A stream of files as they arrive below a folder."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)


def decode_arriving(files: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Starts a query that runs ``plan`` on each batch and appends its rows to Parquet at ``target``, each batch in a folder of
    its own, so that a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums of events by type and window; later events than ``late`` are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
