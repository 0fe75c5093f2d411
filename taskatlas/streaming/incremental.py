"""Incremental labelling and running totals.

A run processes what has arrived since the last one and stops. The stream
checkpoint replaces counting rows already written: input order may change and a
lost executor or driver repeats nothing that was committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_chunk: int = 100) -> DataFrame:
    """Parquet files of a folder or glob as a stream; ``files_per_chunk`` bounds a chunk."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(path)


def run_append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream to Parquet until the input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def label_stream(stream: DataFrame, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Label documents as they arrive. ``label`` must be row-local."""
    return run_append(label(stream), out, checkpoint)


def run_totals(totals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the running totals of a stream, one folder per chunk.

    Rewriting a chunk's folder gives the same content, so a repeated chunk does
    no harm. The last folder holds the totals so far.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/chunk={batch_id}")

    query = (
        totals.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals after the last chunk."""
    history = spark.read.parquet(out)
    last = history.selectExpr("max(chunk) AS c").scalar()
    return history.filter(history["chunk"] == last).drop("chunk")
