"""Shared scratch folders for intermediate tables and stream state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder path under the session's ``spark.checkpoint.dir``, which all executors share.

    Without that setting the context's checkpoint folder is taken; without either
    this fails, on every master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = f"{base.rstrip('/')}/taskatlas/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the folders this process took with ``scratch_dir``; call it when their results are done with."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    count = 0
    while _made:
        path = hadoop.Path(_made.pop())
        count += path.getFileSystem(conf).delete(path, True)
    return count


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to shared storage and read it back, so later steps neither
    repeat the work nor depend on executors that may be lost."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
