"""Exact quantiles with bounded groups.

A built-in exact percentile keeps every distinct value of a group in one buffer.
Here equal values are counted first, or all are written once, and the wanted ranks are
then located by narrowing a histogram, so neither a task nor the driver ever holds more than
``fanout`` counters per wanted rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from taskatlas.sources.storage import stored

FANOUT = 1024


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Distinct non-null values ``x`` with their counts ``n``, written once.

    Copies of a value collapse before the shuffle, and the later passes read the
    table instead of repeating the work that made the values.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    return stored(counted, "value-counts")


def values_once(df: DataFrame, value: str) -> DataFrame:
    """Non-null values ``x`` one by one (``n`` is 1), written once: for values of which few are equal."""
    return stored(df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.lit(1).cast("long").alias("n")), "values")


def _locate(rows: Sequence[Row], ranks: set[int], base: dict[int | None, int]) -> dict[int, int]:
    """Histogram buckets that hold a wanted rank, with the count before each."""
    found, before = {}, {}
    for row in sorted(rows, key=lambda r: r["code"]):
        start = before.setdefault(row["parent"], base[row["parent"]])
        if any(start <= r < start + row["n"] for r in ranks):
            found[row["code"]] = start
        before[row["parent"]] = start + row["n"]
    return found


def exact_quantiles(freq: DataFrame, shares: dict[str, float], *, fanout: int = FANOUT, levels: int = 3) -> DataFrame:
    """One row with a linearly interpolated quantile per name, from ``value_counts`` or ``values_once``.

    Each level splits the buckets that hold a wanted rank into ``fanout`` parts.
    The values of the last, very narrow buckets are counted and ranked by a window.
    """
    spark = freq.sparkSession
    span = freq.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n")).first()
    if span["n"] is None:
        return spark.createDataFrame([tuple([None] * len(shares))], ", ".join(f"{s} double" for s in shares))
    places = {name: share * (span["n"] - 1) for name, share in shares.items()}
    ranks = {f(p) for p in places.values() for f in (floor, ceil)}

    width = (span["hi"] - span["lo"]) or 1.0
    cells = fanout**levels
    code = F.least(F.floor((F.col("x") - span["lo"]) / width * cells), F.lit(cells - 1)).cast("long")
    coded = freq.withColumn("code", code)
    base: dict[int | None, int] = {None: 0}
    for level in range(1, levels + 1):
        size = fanout ** (levels - level)
        at = F.floor(F.col("code") / size).cast("long")
        parent = F.lit(None).cast("long")
        rows = coded
        if level > 1:
            parent = F.floor(F.col("code") / (size * fanout)).cast("long")
            rows = coded.filter(parent.isin(*base))
        # At most fanout rows for each bucket that held a rank.
        counted = rows.groupBy(parent.alias("parent"), at.alias("code")).agg(F.sum("n").alias("n")).collect()
        base = _locate(counted, ranks, base)

    start = F.coalesce(*[F.when(F.col("code") == c, F.lit(b)) for c, b in base.items()])
    earlier = Window.partitionBy("code").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    last = coded.filter(F.col("code").isin(*base)).groupBy("code", "x").agg(F.sum("n").alias("n"))
    values = last.withColumn("first", start + F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def at_rank(rank: int):
        return F.max(F.when((F.col("first") <= rank) & (F.col("first") + F.col("n") > rank), F.col("x")))

    out = [
        (at_rank(floor(p)) + (at_rank(ceil(p)) - at_rank(floor(p))) * (p - floor(p))).alias(name) for name, p in places.items()
    ]
    return values.agg(*out)


def count_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Quantile of a count column per group.

    Counts that sum to S have at most sqrt(2 S) distinct values, so the buffer
    over the pre-counted values stays small at any scale.
    """
    freq = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return freq.groupBy(*keys).agg(F.percentile(value, share, F.col("__n")).alias(name))
