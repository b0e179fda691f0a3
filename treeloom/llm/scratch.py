"""Intermediate tables in the folder that the driver and all executors share.

Long plans are cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading
it again: unlike a cached or locally checkpointed frame it survives the loss of any
executor, and unlike ``checkpoint()`` it is computed once and keeps a columnar schema.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master without any (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one operator run, under a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[DataFrame] = []

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write df once and return the frame that reads it back; its shuffle files go as soon as it is written."""
        path = self.path(label)
        before = self.spark.conf.get(CLEAN_SHUFFLES, "false")
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEAN_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._saved.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(self.spark, path)


    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables of this run but those that a result still reads."""
        for df in self._saved:
            if not any(df is f for f in frames):
                self.drop(df)
        self._saved = list(frames)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession, rows: int = 256, megabytes: int = 2) -> None:
    """Bound Arrow batches by rows and bytes: texts are of any length, workers are small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
