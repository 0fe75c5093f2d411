"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.text import result_name
from taskatlas.sources.readers import suffix_of

# Spaces at the ends of a field are kept, and files stay small enough for one task.
CSV_WRITE = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "maxRecordsPerFile": 500_000,
}


def save_table(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write by suffix: csv, tsv or parquet."""
    suffix = suffix_of(path)
    writer = df.write.mode(mode)
    if suffix == ".parquet":
        writer.parquet(path)
    elif suffix in (".csv", ".tsv"):
        writer.options(**CSV_WRITE, sep="\t" if suffix == ".tsv" else ",").csv(path)
    else:
        raise ValueError(f"unsupported format {suffix!r}")


def write_by_category(wide: DataFrame, folder: str, *, first_year: int, last_year: int, threshold: float) -> None:
    """One output per category, named by year range, category and threshold.

    The name is a partition column, so all categories are written by one job and a
    large category by many tasks.
    """
    name = result_name(F.col("ai_category"), F.lit(first_year), F.lit(last_year), threshold)
    named = wide.withColumn("name", name).drop("ai_category")
    named.write.mode("overwrite").options(**CSV_WRITE).partitionBy("name").csv(folder)


def save_embeddings(df: DataFrame, path: str) -> None:
    df.select("id", "vec").write.mode("overwrite").parquet(path)
