"""Tables written to the folder that the whole cluster shares.

An operator that uses an intermediate result more than once, or that must cut
its lineage, writes it as Parquet below ``spark.checkpoint.dir``: executors can
then be lost without losing the result. Where the setting is missing (tests,
a laptop) a temporary folder of this machine is set once per session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


#: Bytes of a batch of rows on its way to or from a Python worker, so that long texts don't make batches long.
BATCH = 2_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":
        spark.conf.set(key, BATCH)


def remove_runs(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all runs below the shared folder; results that read them must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that one file of an intermediate table holds at least, where a table is small for the cluster.
FILE = 16_000_000


class Stage:
    """Intermediate tables of one operator run; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.files: int | None = None
        bounded_batches(spark)
        self.base = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"

    def expect(self, size: int) -> None:
        """Tables saved from now on have about so many bytes at most: they get no more files (and tasks that write them) than that
        takes, or two for each core, so that small tables don't become many tiny files."""
        self.files = max(2 * self.spark.sparkContext.defaultParallelism, -(-size // FILE))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        (df if self.files is None else df.coalesce(self.files)).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
