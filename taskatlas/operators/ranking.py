"""Row numbers and top-k without a window over an unbounded group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LEAST_BUCKETS, BUCKET_ROWS = 256, 1_000_000


def number_rows(df: DataFrame, order_col: str, name: str, *, buckets: int | None = None) -> DataFrame:
    """Number rows from 0 in ``order_col`` order (a numeric column without repeats); nulls come last.

    Approximate quantiles cut the order into buckets of near-equal size; rows are
    numbered inside their bucket and shifted by the size of the buckets before
    it. The driver reads the cuts, and one task meets the bucket table: both have
    at most ``buckets`` entries, by default one for ``BUCKET_ROWS`` rows, so that no task
    sorts more the larger the table is.
    """
    buckets = buckets or max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    shares = [i / buckets for i in range(1, buckets)]
    number = F.col(order_col).cast("double")
    cuts = df.agg(F.percentile_approx(number, shares, F.lit(20 * buckets)).alias("c")).first()["c"] or [0.0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    # Nulls get a bucket of their own after the others.
    cutter = Bucketizer(splits=splits, inputCol="__number", outputCol="__bucket", handleInvalid="keep")
    placed = cutter.transform(df.withColumn("__number", number)).drop("__number")
    placed = placed.withColumn("__bucket", F.coalesce("__bucket", F.lit(float(len(splits)))))
    sizes = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(order_col))
    return (
        placed.withColumn("__rn", inside)
        .join(starts, "__bucket")
        .withColumn(name, (F.col("__start") + F.col("__rn") - 1).cast("long"))
        .drop("__bucket", "__rn", "__start")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group in a total order.

    The ``row_number <= k`` filter is planned with a limit before the shuffle, so
    a group never sends more than ``k`` rows per input task.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)
