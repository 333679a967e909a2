"""Cuts of lineage in the folder that the cluster names, and rows spread over its cores."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; in a temporary folder only where none is named and all runs on this machine."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan in as many partitions as there are cores, if it has fewer: a table so small that dealing it out costs less than the work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of an Arrow batch that goes to a task's Python worker.
BATCH_BYTES = 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, however long the rows; plans read the setting when they run, so it stays set in the session, and a smaller one is left alone."""
    held = str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).lower().removesuffix("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
