"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.sources.storage import stored

def hot_keys(facts: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and the number of salts that cuts them to that size."""
    counted = facts.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows)
    return counted.select(*keys, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))


def spread_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", *, hot_rows: int | None = None) -> DataFrame:
    """Join ``facts`` to a lookup with one row per key.

    ``how`` is inner, left or left_semi. The adaptive skew join splits a hot key's
    fact rows, and copies the lookup rows only for the pieces it makes. With
    ``hot_rows`` the split is made here as well, for sessions without that feature:
    keys with more rows are counted and salted, all others are joined as they are.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("the fact side must be kept whole or filtered: inner, left or left_semi")
    if hot_rows is None:
        return facts.join(lookup, list(keys), how)
    # Both sides of the plan read the counts, of which there are at most rows / hot_rows.
    hot = stored(hot_keys(facts, keys, hot_rows), "hot-keys")
    parts = facts.columns
    # Spread by row content, so a task that runs again sends each row to the same place.
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in parts]), F.coalesce("__salts", F.lit(1))).cast("int")
    spread = facts.join(hot, list(keys), "left").withColumn("__salt", salt).select(*parts, "__salt")
    copies = lookup.join(hot, list(keys), "left")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")


def add_totals(df: DataFrame, keys: Sequence[str], aggregates: Sequence) -> DataFrame:
    """Group totals beside each row.

    A window would bring a whole group into one task; here the totals are
    aggregated with partial sums and joined back. ``df`` is read twice: store it
    first when it is costly.
    """
    keyed = df.filter(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    return spread_join(keyed, keyed.groupBy(*keys).agg(*aggregates), keys)


def update_merge(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Non-null right values replace left values; left rows and columns are kept."""
    shared = [c for c in left.columns if c != id_col and c in right.columns]
    renamed = right.select(id_col, *[F.col(c).alias(f"__r_{c}") for c in shared])
    joined = left.join(renamed, id_col, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__r_{c}"), F.col(c)).alias(c) if c in shared else F.col(c)
            for c in left.columns
        ]
    )


def remaining(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id has not been processed."""
    return df.join(done.select(id_col), id_col, "left_anti")


def fan_out_counts(ratings: DataFrame, counts: DataFrame, on: str = "task") -> DataFrame:
    """Give each rating row the counts of its task text; no count becomes 0.

    ``counts`` has one row per task.
    """
    value_cols = [c for c in counts.columns if c != on]
    return spread_join(ratings, counts, [on], "left").na.fill(0, value_cols)


def compare_results(left: DataFrame, right: DataFrame, id_col: str, suffixes: tuple[str, str] = ("_single", "_ensemble")) -> DataFrame:
    """Inner join of two results; shared columns get the suffixes."""
    shared = {c for c in left.columns if c in right.columns and c != id_col}

    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(id_col, *[F.col(c).alias(c + suffix if c in shared else c) for c in df.columns if c != id_col])

    return named(left, suffixes[0]).join(named(right, suffixes[1]), id_col)
