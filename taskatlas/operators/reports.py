"""Counts, shares and distribution reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskatlas.operators.quantiles import exact_quantiles, values_once


def _percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * F.try_divide(part, whole), 4)


def category_distribution(df: DataFrame, category_col: str) -> DataFrame:
    """Rows and percent per category, most frequent first.

    The percent is of all rows; rows without a category count in it but are not listed.
    """
    counts = df.groupBy(F.col(category_col).alias("category")).agg(F.count("*").alias("n"))
    # The window sees one row per category.
    everything = F.sum("n").over(Window.partitionBy(F.lit(0)))
    listed = counts.withColumn("percent", _percent(F.col("n"), everything)).filter(F.col("category").isNotNull())
    return listed.orderBy(F.col("n").desc(), F.col("category"))


def mean_confidence(df: DataFrame, confidence_col: str = "confidence") -> DataFrame:
    return df.agg(F.round(F.avg(confidence_col), 6).alias("mean_confidence"))


def confidence_bands(df: DataFrame, confidence_col: str = "confidence", *, high: float = 0.7, medium: float = 0.5) -> DataFrame:
    c = F.col(confidence_col)
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(c >= high).alias("high"),
        F.count_if((c >= medium) & (c < high)).alias("medium"),
        F.count_if(c < medium).alias("low"),
    )
    entries = [
        F.struct(F.lit(b).alias("band"), F.col(b).alias("n"), _percent(F.col(b), F.col("total")).alias("percent"))
        for b in ("high", "medium", "low")
    ]
    return counts.select(F.inline(F.array(*entries)))


def vote_histogram(df: DataFrame, votes_col: str = "ensemble_votes") -> DataFrame:
    counts = df.groupBy(F.col(votes_col).alias("votes")).agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", _percent(F.col("n"), everything)).orderBy("votes")


def similarity_distribution(df: DataFrame, col: str = "sim", *, digits: int = 6) -> DataFrame:
    """Mean, population deviation, extremes and exact quartiles of a score.

    The scores are written once as they are: nearly all differ, so counting them would
    hold most of them in memory. Equal scores are counted in the last narrow buckets.
    """
    freq = values_once(df, col)
    n, x = F.col("n"), F.col("x")
    mean = freq.agg(F.sum(x * n) / F.sum(n)).first()[0]
    off = x - F.lit(mean).cast("double")
    plain = freq.agg(F.sqrt(F.sum(n * off * off) / F.sum(n)).alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).first()
    known = {"mean": mean, **plain.asDict()}
    cuts = exact_quantiles(freq, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return cuts.select(
        *[F.round(F.lit(v).cast("double"), digits).alias(c) for c, v in known.items()],
        *[F.round(c, digits).alias(c) for c in cuts.columns],
    )


def match_quality(matches: DataFrame, ratings: DataFrame, *, above: float = 0.8) -> DataFrame:
    """Mean similarity, matches above a limit and the share of occupations covered.

    ``matches`` has ``soc_code`` and ``sim``.
    """
    found = matches.agg(
        F.round(F.avg("sim"), 6).alias("mean_similarity"),
        F.count_if(F.col("sim") > above).alias("high_matches"),
        F.countDistinct("soc_code").alias("covered"),
    )
    every = ratings.agg(F.countDistinct("soc_code").alias("n")).scalar()
    return found.select(
        "mean_similarity", "high_matches", "covered", every.alias("occupations"),
        F.round(F.try_divide(F.col("covered"), every), 6).alias("coverage"),
    )


def year_summary(counts: DataFrame) -> DataFrame:
    """Per category and year: all matches, rating rows with matches, mean per rating row."""
    return counts.groupBy("ai_category", "year").agg(
        F.sum("matches").alias("total_matches"),
        F.count_if(F.col("matches") > 0).alias("tasks_with_matches"),
        F.round(F.avg("matches"), 6).alias("mean_matches"),
    )


def documents_per_category(df: DataFrame, category_col: str, wanted: Sequence[str]) -> DataFrame:
    """Documents of each wanted category; a category without documents has 0."""
    names = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(wanted)], "pos int, category string")
    counts = df.filter(F.col(category_col).isin(*wanted)).groupBy(F.col(category_col).alias("category")).agg(
        F.count("*").alias("n")
    )
    # Both sides have at most one row per wanted name.
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("documents"))
