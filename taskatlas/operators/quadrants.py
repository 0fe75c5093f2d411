"""Importance against matches: points, quadrants, outliers and summaries.

Input is the long match-count table restricted to importance ratings.
Cuts are medians of the non-zero match counts of a year. A year without any match
has no cut: its rows are in no quadrant, and the year is reported with counts of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.statistics import two_sided_p
from taskatlas.operators.quantiles import count_quantile
from taskatlas.operators.ranking import top_per_group

CHART_IMPORTANCE = 3.5
HIGH_IMPORTANCE = 4.0
LOW_IMPORTANCE = 3.0
OUTLIER_FACTOR = 1.5
HIGH_MATCHES = 50


def points(counts: DataFrame) -> DataFrame:
    """One point per rating row and category, zeros kept."""
    return counts.select("year", "task", F.col("data_value").alias("importance"), "matches", "ai_category", F.col("title").alias("occupation"))


def task_points(counts: DataFrame, order: Column | None = None) -> DataFrame:
    """Points summed over categories, zeros dropped; the occupation is the first by ``order``."""
    first = F.min_by("title", order if order is not None else F.struct("soc_code", "title"))
    return counts.filter(F.col("matches") > 0).groupBy("year", "task", F.col("data_value").alias("importance")).agg(
        F.sum("matches").alias("matches"), first.alias("occupation")
    )


def all_year_points(counts: DataFrame, *, by_category: bool = True) -> DataFrame:
    """Points of all years without zeros, per category or summed."""
    kept = counts.filter(F.col("matches") > 0)
    if by_category:
        return kept.select("task", F.col("data_value").alias("importance"), "year", "matches", "ai_category")
    return kept.groupBy("task", F.col("data_value").alias("importance"), "year").agg(F.sum("matches").alias("matches"))


def match_cut(counts: DataFrame, share: float = 0.5, *, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Quantile of the non-zero match counts per year, or over all rows with no ``keys``."""
    return count_quantile(counts.filter(F.col("matches") > 0), list(keys), "matches", share, "cut")


def _with_cut(counts: DataFrame, share: float) -> DataFrame:
    """Every row with the cut of its year, null without one; a null year is a year of its own."""
    cuts = match_cut(counts, share).withColumnRenamed("year", "__year")
    return counts.join(cuts, F.col("year").eqNullSafe(F.col("__year")), "left").drop("__year")


def quadrant(importance: Column, matches: Column, cut: Column, high_importance: float) -> Column:
    important, many = importance >= high_importance, matches >= cut
    return (
        F.when(cut.isNull(), F.lit(None))
        .when(important & many, "high_concern").when(important, "protected").when(many, "routine_automation").otherwise("minimal_impact")
    )


def quadrant_counts(counts: DataFrame, *, high_importance: float = HIGH_IMPORTANCE, share: float = 0.5) -> DataFrame:
    """Rows and percent per quadrant and year, all 0 in a year without matches."""
    rows = _with_cut(counts, share)
    named = rows.withColumn("quadrant", quadrant(F.col("data_value"), F.col("matches"), F.col("cut"), high_importance))
    names = ["high_concern", "protected", "routine_automation", "minimal_impact"]
    sizes = named.groupBy("year").pivot("quadrant", names).count().na.fill(0, names)
    total = sum((F.col(n) for n in names), F.lit(0))
    entries = [
        F.struct(F.lit(n).alias("quadrant"), F.col(n).alias("n"), F.round(F.coalesce(100.0 * F.try_divide(F.col(n), total), F.lit(0.0)), 4).alias("percent"))
        for n in names
    ]
    return sizes.select("year", F.inline(F.array(*entries)))


def outliers(counts: DataFrame, n: int = 10) -> DataFrame:
    """Important tasks with at least 1.5 times the median matches, the largest ``n`` per year."""
    rows = _with_cut(counts.filter(F.col("matches") > 0), 0.5).filter(
        (F.col("data_value") >= HIGH_IMPORTANCE) & (F.col("matches") >= F.col("cut") * OUTLIER_FACTOR)
    )
    order = [F.col("matches").desc(), F.col("task").asc(), F.col("ai_category").asc(), F.col("soc_code").asc()]
    return top_per_group(rows, ["year"], order, n, rank="rank").select(
        "year", "rank", "task", "ai_category", "title", F.col("data_value").alias("importance"), "matches"
    )


def importance_summary(counts: DataFrame, *, high_matches: int = HIGH_MATCHES) -> DataFrame:
    """Per year: rows with high importance, and of these the ones with many matches."""
    important = F.col("data_value") >= HIGH_IMPORTANCE
    return counts.groupBy("year").agg(
        F.count_if(important).alias("important_rows"),
        F.count_if(important & (F.col("matches") >= high_matches)).alias("many_matches"),
    )


def top_important(counts: DataFrame, n: int = 5, *, high_matches: int = HIGH_MATCHES) -> DataFrame:
    rows = counts.filter((F.col("data_value") >= HIGH_IMPORTANCE) & (F.col("matches") >= high_matches))
    order = [F.col("matches").desc(), F.col("task").asc(), F.col("ai_category").asc(), F.col("soc_code").asc()]
    return top_per_group(rows, ["year"], order, n, rank="rank").select("year", "rank", "task", "ai_category", "matches", F.col("data_value").alias("importance"))


def _correlations(counts: DataFrame) -> DataFrame:
    base = counts.dropna(subset=["data_value", "matches"]).groupBy("year").agg(
        F.corr("data_value", "matches").alias("r"), F.count("*").alias("n")
    )
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r")))
    return base.withColumn("t", t)


def importance_correlation(counts: DataFrame) -> DataFrame:
    """Pearson correlation of importance and matches per year, its n and t statistic."""
    return _correlations(counts).select("year", F.round("r", 6).alias("r"), "n", F.round("t", 6).alias("t"))


def correlation_test(counts: DataFrame) -> DataFrame:
    """The correlation of a year with the two-sided p-value of no correlation, to nine digits."""
    p = two_sided_p(F.col("t"), F.col("n") - 2)
    return _correlations(counts).select("year", F.round("r", 6).alias("r"), "n", F.round(p, 9).alias("p"))


def change_by_importance(counts: DataFrame, first: int, last: int) -> DataFrame:
    """Mean change in matches from the first to the last year for important and routine rows."""
    at = lambda y: F.sum(F.when(F.col("year") == y, F.col("matches")).otherwise(F.lit(0)))
    rows = counts.groupBy("soc_code", "task", "ai_category", "data_value").agg((at(last) - at(first)).alias("change"))
    return rows.agg(
        F.round(F.avg(F.when(F.col("data_value") >= HIGH_IMPORTANCE, F.col("change"))), 6).alias("important_change"),
        F.round(F.avg(F.when(F.col("data_value") < LOW_IMPORTANCE, F.col("change"))), 6).alias("routine_change"),
    )


def high_concern(counts: DataFrame, *, share: float = 0.5) -> DataFrame:
    """Important rows at or above the cut of their year."""
    rows = _with_cut(counts, share)
    kept = rows.filter((F.col("data_value") >= HIGH_IMPORTANCE) & (F.col("matches") >= F.col("cut")))
    return kept.select("year", "task", "title", "ai_category", F.col("data_value").alias("importance"), "matches")


def concern_by_occupation(concern: DataFrame) -> DataFrame:
    """Per occupation and year: high-concern tasks, mean importance, matches, priority."""
    grouped = concern.groupBy("year", "title").agg(
        F.count("task").alias("tasks"), F.avg("importance").alias("mean_importance"), F.sum("matches").alias("total_matches")
    )
    score = F.col("tasks") * F.col("mean_importance") * F.col("total_matches")
    return grouped.select(
        "year", "title", "tasks", F.round("mean_importance", 6).alias("mean_importance"), "total_matches",
        F.round(score, 4).alias("priority"),
    )


def top_priority(concern: DataFrame, n: int = 5) -> DataFrame:
    return top_per_group(
        concern_by_occupation(concern), ["year"], [F.col("priority").desc(), F.col("title").asc()], n, rank="rank"
    )
