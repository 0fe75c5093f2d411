"""Occupational exposure from match counts, and the reports on it.

Match counts are long rows ``(soc_code, title, task, scale_name, task_category,
data_value, ai_category, year, matches)``; exposure is
``(soc_code, title, ai_category, year, exposure)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.operators.filters import importance_only, task_contains
from taskatlas.operators.joins import fan_out_counts
from taskatlas.operators.ranking import top_per_group
from taskatlas.operators.reshape import long_to_wide

# Lower bounds of the exposure bands.
BANDS = ((4.0, "very high"), (3.0, "high"), (2.0, "moderate"), (1.0, "low"), (0.0, "minimal"))
DIGITS = 6
SUM_DIGITS = 9


def task_matches(ratings: DataFrame, counts: DataFrame, categories: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Match counts of every rating row for all listed categories and years, 0 where none.

    ``counts`` is ``(task, category, year, matches)``. The zero rows come from a
    pivot on the listed values, one row per task, and not from a product of tables.
    """
    slots = [(c, y) for c in categories for y in years]
    names = [f"s{i}" for i in range(len(slots))]
    slot = F.coalesce(*[F.when((F.col("category") == c) & (F.col("year") == y), F.lit(n)) for (c, y), n in zip(slots, names)])
    wide = counts.withColumn("slot", slot).groupBy("task").pivot("slot", names).agg(F.sum("matches"))
    filled = fan_out_counts(ratings, wide)
    entries = [
        F.struct(F.lit(c).alias("ai_category"), F.lit(y).alias("year"), F.col(n).alias("matches"))
        for (c, y), n in zip(slots, names)
    ]
    return filled.select(*ratings.columns, F.inline(F.array(*entries)))


def exposure(counts: DataFrame) -> DataFrame:
    """Importance-weighted exposure per occupation, category and year.

    ``sum(matches * importance) / sum(matches)`` over importance ratings, 0 when
    nothing matched, 4 decimals rounded half to even. The quotient is first
    rounded to 9 decimals: the order in which a distributed sum adds up must not
    decide a half. Rows with a null importance, count, code or title do not take part.
    """
    usable = importance_only(counts).dropna(subset=["data_value", "matches", "soc_code", "title"])
    grouped = usable.groupBy("soc_code", "title", "ai_category", "year").agg(
        F.sum(F.col("matches") * F.col("data_value")).alias("weighted"), F.sum("matches").alias("total")
    )
    value = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("weighted"), F.col("total")))
    return grouped.select("soc_code", "title", "ai_category", "year", F.bround(F.round(value, SUM_DIGITS), 4).alias("exposure"))


def unusable_rows(counts: DataFrame) -> DataFrame:
    """How many importance rows exposure leaves out, by reason."""
    rows = importance_only(counts)
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("data_value").isNull()).alias("no_importance"),
        F.count_if(F.col("matches").isNull()).alias("no_count"),
        F.count_if(F.col("soc_code").isNull() | F.col("title").isNull()).alias("no_occupation"),
    )


def exposure_wide(exposed: DataFrame, years: Sequence[int]) -> DataFrame:
    wide = long_to_wide(exposed, ["soc_code", "title", "ai_category"], "year", years, F.first("exposure"))
    return wide.orderBy("soc_code", "title", "ai_category")


def mean_by_category(exposed: DataFrame) -> DataFrame:
    """Mean over years of the mean over occupations."""
    yearly = exposed.groupBy("ai_category", "year").agg(F.avg("exposure").alias("m"))
    return yearly.groupBy("ai_category").agg(F.round(F.avg("m"), DIGITS).alias("mean_exposure"))


def top_occupations(exposed: DataFrame, n: int = 10) -> DataFrame:
    """Occupations with the highest mean over years of the mean over categories."""
    yearly = exposed.groupBy("soc_code", "title", "year").agg(F.avg("exposure").alias("m"))
    means = yearly.groupBy("soc_code", "title").agg(F.round(F.avg("m"), DIGITS).alias("mean_exposure"))
    return means.orderBy(F.col("mean_exposure").desc(), "soc_code", "title").limit(n)


def growth(exposed: DataFrame, first: int, last: int) -> DataFrame:
    """Percent change between two years; null when the first value is 0 or absent."""
    keys = ["soc_code", "title", "ai_category"]
    wide = exposed.filter(F.col("year").isin(first, last)).groupBy(*keys).agg(
        F.max(F.when(F.col("year") == first, F.col("exposure"))).alias("first_exposure"),
        F.max(F.when(F.col("year") == last, F.col("exposure"))).alias("last_exposure"),
    )
    change = F.try_divide(F.col("last_exposure") - F.col("first_exposure"), F.col("first_exposure")) * 100
    return wide.withColumn("growth_percent", F.round(change, DIGITS))


def top_growth(exposed: DataFrame, first: int, last: int, n: int = 10) -> DataFrame:
    return growth(exposed, first, last).orderBy(
        F.col("growth_percent").desc_nulls_last(), "soc_code", "title", "ai_category"
    ).limit(n)


def breadth(exposed: DataFrame) -> DataFrame:
    """Occupations with any exposure above 0, per category."""
    touched = F.when(F.col("exposure") > 0, F.struct("soc_code", "title"))
    return exposed.groupBy("ai_category").agg(F.countDistinct(touched).alias("occupations"))


def occupation_profile(exposed: DataFrame, title: str, year: int) -> DataFrame:
    """Categories of one occupation in one year, highest first."""
    rows = exposed.filter((F.col("title") == title) & (F.col("year") == year))
    return rows.select("ai_category", "exposure").orderBy(F.col("exposure").desc(), "ai_category")


def exposure_band(col: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, name in reversed(BANDS):
        out = F.when(col >= low, F.lit(name)).otherwise(out)
    return out


def category_trend(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ai_category", "year").agg(F.sum("matches").alias("total_matches"))


def occupation_trend(counts: DataFrame) -> DataFrame:
    return counts.groupBy("title", "ai_category", "year").agg(F.sum("matches").alias("total_matches"))


def leading_category(counts: DataFrame) -> DataFrame:
    """Category with most matches per occupation and year; equal totals go to the first name."""
    totals = counts.groupBy("title", "year", "ai_category").agg(F.sum("matches").alias("total_matches"))
    return top_per_group(totals, ["title", "year"], [F.col("total_matches").desc(), F.col("ai_category").asc()], 1)


def top_tasks(counts: DataFrame, ai_category: str, year: int, n: int = 10) -> DataFrame:
    rows = counts.filter((F.col("ai_category") == ai_category) & (F.col("year") == year))
    return rows.select("title", "task", "matches").orderBy(F.col("matches").desc(), "task", "title").limit(n)


def task_across_categories(counts: DataFrame, pattern: str, categories: Sequence[str]) -> DataFrame:
    """Matches of the tasks that fit a pattern, one column per category."""
    found = task_contains(counts, pattern)
    return long_to_wide(found, ["task", "title", "year"], "ai_category", categories, F.sum("matches"))
