"""Duplicate removal and set-style reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.operators.ranking import top_per_group


def drop_identical(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column; copies collapse before the shuffle."""
    return df.distinct()


def keep_first(df: DataFrame, keys: Sequence[str], order_col: str | Column) -> DataFrame:
    """First row per key in source order; one row per key and task is shuffled."""
    order = F.col(order_col) if isinstance(order_col, str) else order_col
    return top_per_group(df, keys, [order.asc()], 1)


def keep_first_text(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """First row (by ``id_col``) of each distinct text.

    Texts are long, so the first pass shuffles only a digest and the smallest id.
    """
    first = df.groupBy(F.sha2(F.col(text_col), 256).alias("__digest")).agg(F.min(id_col).alias(id_col))
    return df.join(first.select(id_col), id_col, "left_semi")


def distinct_tasks(ratings: DataFrame, order_col: str) -> DataFrame:
    """Distinct task texts with the position of their first use."""
    return ratings.groupBy("task").agg(F.min(order_col).alias("first_seen"))


def id_overlap(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """One row: ids in both inputs, in the left only, in the right only."""
    sides = (
        left.select(id_col, F.lit(1).alias("__side"))
        .unionByName(right.select(id_col, F.lit(2).alias("__side")))
        .filter(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.bit_or("__side").alias("__sides"))
    )
    return sides.agg(
        F.count_if(F.col("__sides") == 3).alias("in_both"),
        F.count_if(F.col("__sides") == 1).alias("left_only"),
        F.count_if(F.col("__sides") == 2).alias("right_only"),
    )


def concat_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack results; a column absent from a part is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
