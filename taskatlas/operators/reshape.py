"""Wide and long forms of yearly results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_columns(df: DataFrame) -> list[str]:
    """Columns named like a year (``2021`` or ``2021.0``) in numeric order."""

    def year(name: str) -> float | None:
        try:
            value = float(name)
        except ValueError:
            return None
        return value if 1900 <= value <= 2100 else None

    return sorted((c for c in df.columns if year(c) is not None), key=float)


def years_to_long(df: DataFrame, value: str = "matches", years: Sequence[str] | None = None) -> DataFrame:
    """One row per year column; other columns are kept."""
    years = list(years or year_columns(df))
    if not years:
        raise ValueError(f"no year columns in {df.columns}")
    ids = [F.col(f"`{c}`") for c in df.columns if c not in years]
    long = df.unpivot(ids, [F.col(f"`{y}`") for y in years], "year", value)
    return long.withColumn("year", F.col("year").cast("double").cast("int"))


def long_to_wide(df: DataFrame, keys: Sequence[str], by: str, values: Sequence, agg: Column) -> DataFrame:
    """One column per listed value; naming the values saves the job that would find them."""
    return df.groupBy(*keys).pivot(by, list(values)).agg(agg)
