"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.operators.ranking import top_per_group


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def labelled_texts(documents: DataFrame, labels: DataFrame, max_rows: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, label``: at most ``max_rows`` ids of each label with their texts.

    Ids are taken by the hash of the id before any text is read, so only that
    bounded list is broadcast to the scan of the documents. An id with several
    labels has the largest; null ids and labels take no part. Of rows that share
    an id one is kept, which also bounds the result.
    """
    one = labels.select(F.col(id_col).alias("doc_id"), F.col("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = top_per_group(one, ["label"], [F.xxhash64("doc_id"), F.col("doc_id")], max_rows)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
