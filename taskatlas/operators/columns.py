"""Column choice: schema checks, fallbacks and defaults decided on ``df.columns``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskatlas.functions.text import clean_text
from taskatlas.operators.ranking import number_rows

# Column names tried in turn, and the defaults when none is there.
TITLE_NAMES = ("application_title", "title", "patent_title")
YEAR_NAMES = ("year", "Year", "filing_year", "application_year", "grant_year")
DATE_NAMES = ("filing_date", "published_date")
DEFAULT_YEAR = 2021
DEFAULT_TOPIC = "Machine Learning"
DEFAULT_OCCUPATION = "Occupation"

# Rating-file headings and the names used here.
RATING_NAMES = {
    "Task ID": "task_id",
    "Task": "task",
    "Title": "title",
    "O*NET-SOC Code": "soc_code",
    "Scale Name": "scale_name",
    "Category": "task_category",
    "Data Value": "data_value",
}
RESULT_COLUMNS = ("soc_code", "title", "task", "scale_name", "task_category", "data_value")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, available: {df.columns}")
    return df


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of ``names`` that is a column, case-sensitive."""
    return next((n for n in names if n in df.columns), None)


def first_text_column(df: DataFrame) -> str | None:
    return next((f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)), None)


def with_title(df: DataFrame) -> DataFrame:
    """Ensure ``application_title`` from its aliases, else the first text column."""
    source = first_present(df, TITLE_NAMES) or first_text_column(df)
    if source is None or source == TITLE_NAMES[0]:
        return df
    return df.withColumn(TITLE_NAMES[0], F.col(source))


def with_id(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Ensure ``application_id`` from ``id``, else the row number from 0 by ``order_col``."""
    if "application_id" in df.columns:
        return df
    if "id" in df.columns:
        return df.withColumn("application_id", F.col("id"))
    if order_col is None:
        raise ValueError("no id column: name the column that gives the row order")
    return number_rows(df, order_col, "application_id")


def to_year(col: Column) -> Column:
    """Year of a date text, null when it does not parse."""
    return F.year(F.try_to_timestamp(col.cast("string")))


def with_year(df: DataFrame) -> DataFrame:
    """Ensure an INT ``year`` from the filing date, the publication date, or the default."""
    if "year" in df.columns:
        return df
    source = first_present(df, DATE_NAMES)
    return df.withColumn("year", F.lit(DEFAULT_YEAR) if source is None else to_year(F.col(source)))


def with_default(df: DataFrame, name: str, value: str) -> DataFrame:
    """Add a constant column when it is absent."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def with_task(df: DataFrame) -> DataFrame:
    """Ensure ``task``: itself, else a column with "task" in its name, else the first text column."""
    if "task" in df.columns:
        return df
    source = next((c for c in df.columns if "task" in c.lower()), None) or first_text_column(df)
    return df if source is None else df.withColumn("task", F.col(source))


def rename_ratings(df: DataFrame) -> DataFrame:
    """Rating-file headings to plain names."""
    return df.withColumnsRenamed({k: v for k, v in RATING_NAMES.items() if k in df.columns})


def prepare_documents(df: DataFrame, order_col: str) -> DataFrame:
    """Fallback columns, one row per id (first by ``order_col``), clean titles."""
    from taskatlas.operators.dedup import keep_first

    df = with_default(with_year(with_id(with_title(df), order_col)), "topic_label", DEFAULT_TOPIC)
    df = keep_first(df, ["application_id"], order_col)
    return df.withColumn("application_title", clean_text(F.col("application_title")))


def prepare_tasks(df: DataFrame) -> DataFrame:
    df = with_default(with_task(df), "title", DEFAULT_OCCUPATION)
    return df.withColumn("task", clean_text(F.col("task")))
