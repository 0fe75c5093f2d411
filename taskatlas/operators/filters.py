"""Row filters. All are plain predicates that reach the scan where the source allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.text import INVALID_LABELS
from taskatlas.operators.columns import YEAR_NAMES, first_present, to_year


def valid_category(col: Column) -> Column:
    return col.isNotNull() & ~col.isin(*INVALID_LABELS)


def filter_documents(
    df: DataFrame,
    *,
    category_col: str | None = None,
    topics: DataFrame | None = None,
    topic_flag: int = 1,
    topic_col: str = "topic_label",
) -> DataFrame:
    """Keep documents with a valid category, else with a listed topic, else all.

    ``topics`` has the columns ``flag`` and ``topic``. The semi join is not
    hinted: the planner broadcasts the lookup only while it is small.
    """
    if category_col is not None and category_col in df.columns:
        return df.filter(valid_category(F.col(category_col)))
    if topics is not None:
        listed = topics.filter(F.col("flag") == topic_flag).select(F.col("topic").alias(topic_col)).distinct()
        return df.join(listed, topic_col, "left_semi")
    return df


def in_year(df: DataFrame, year: int) -> DataFrame:
    return df.filter(F.col("year") == year)


def from_year(df: DataFrame, start: int) -> DataFrame:
    """Year (or the year of ``published_date``) as a number, null years dropped, ``>= start``."""
    if "year" not in df.columns and "published_date" in df.columns:
        df = df.withColumn("year", to_year(F.col("published_date")))
    if "year" not in df.columns:
        return df
    # Through double, because years arrive as 2021 and as 2021.0.
    year = F.col("year").cast("string").try_cast("double").try_cast("int")
    return df.withColumn("year", year).filter(F.col("year") >= start)


def from_first_year_column(df: DataFrame, start: int) -> DataFrame:
    """``>= start`` on the first year-like column present; no such column keeps all rows."""
    name = first_present(df, YEAR_NAMES)
    return df if name is None else df.filter(F.col(name) >= start)


def importance_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("scale_name") == "Importance")


def at_least(df: DataFrame, score_col: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score_col) >= threshold)


def low_confidence(df: DataFrame, confidence_col: str = "confidence", below: float = 0.5) -> DataFrame:
    return df.filter(F.col(confidence_col) < below)


def text_present(df: DataFrame, text_col: str) -> DataFrame:
    return df.filter(F.col(text_col).isNotNull())


def task_contains(df: DataFrame, pattern: str, col: str = "task") -> DataFrame:
    """Case-insensitive pattern search; null never matches."""
    return df.filter(F.coalesce(F.col(col).rlike(f"(?i){pattern}"), F.lit(False)))


def quality_filter(
    df: DataFrame,
    *,
    min_confidence: float | None = None,
    min_votes: int | None = None,
    prefix: str = "ensemble",
) -> DataFrame:
    """Inclusive limits on confidence and votes; a null confidence is dropped."""
    if min_confidence is not None:
        df = df.filter(F.col(f"{prefix}_confidence") >= min_confidence)
    if min_votes is not None:
        df = df.filter(F.col(f"{prefix}_votes") >= min_votes)
    return df


def quality_report(df: DataFrame, *, min_confidence: float, min_votes: int, prefix: str = "ensemble") -> DataFrame:
    """Rows left and removed after each limit, from one pass."""
    sure = F.coalesce(F.col(f"{prefix}_confidence") >= min_confidence, F.lit(False))
    agreed = F.coalesce(F.col(f"{prefix}_votes") >= min_votes, F.lit(False))
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(sure).alias("after_confidence"),
        F.count_if(sure & agreed).alias("after_votes"),
    )
    return counts.select(
        "total",
        "after_confidence",
        (F.col("total") - F.col("after_confidence")).alias("removed_by_confidence"),
        "after_votes",
        (F.col("after_confidence") - F.col("after_votes")).alias("removed_by_votes"),
        F.round(100.0 * F.try_divide(F.col("after_votes"), F.col("total")), 4).alias("kept_percent"),
    )


def kept_report(df: DataFrame, condition: Column) -> DataFrame:
    """Rows before and after a filter and the share kept, from one pass."""
    counts = df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(F.coalesce(condition, F.lit(False))).alias("rows_after"),
    )
    share = 100.0 * F.try_divide(F.col("rows_after"), F.col("rows_before"))
    return counts.withColumn("kept_percent", F.round(share, 4))
