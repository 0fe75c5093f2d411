"""Readers for document, rating and result files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskatlas.functions.text import category_from_name
from taskatlas.operators.columns import RATING_NAMES, RESULT_COLUMNS, rename_ratings, require_columns
from taskatlas.operators.dedup import concat_results, drop_identical
from taskatlas.operators.reshape import year_columns, years_to_long
from taskatlas.sources.records import has_breaks, read_quoted

# Quotes are doubled inside quoted fields. An empty field is null.
CSV_READ = {"header": True, "quote": '"', "escape": '"'}
NAME_PREFIX = "name="

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("application_id", T.LongType()),
        T.StructField("application_title", T.StringType()),
        T.StructField("application_abstract", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("topic_label", T.StringType()),
    ]
)
NUMBER_COLUMNS = {"task_id": "long", "data_value": "double"}


def suffix_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, *, multi_line: bool = False) -> DataFrame:
    """CSV, or TSV when the name ends in ``.tsv``. Without a schema all columns are text.

    Line breaks inside quoted fields are found wherever files are split (see
    ``records``); a quoted field that never ends is an error. With ``multi_line`` each file
    is read by one task instead.
    """
    sep = "\t" if suffix_of(path) == ".tsv" else ","
    if not multi_line and has_breaks(spark, path):
        return read_quoted(spark, path, schema, sep=sep)
    reader = spark.read.options(**CSV_READ, multiLine=multi_line, sep=sep)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA, *, multi_line: bool = False) -> DataFrame:
    """Documents without fully repeated rows."""
    return drop_identical(read_delimited(spark, path, schema, multi_line=multi_line))


def read_ratings(spark: SparkSession, path: str, *, required: tuple[str, ...] = RESULT_COLUMNS, multi_line: bool = False) -> DataFrame:
    """Task ratings from Parquet or delimited files, plain names, required columns checked."""
    raw = spark.read.parquet(path) if suffix_of(path) == ".parquet" else read_delimited(spark, path, multi_line=multi_line)
    named = require_columns(rename_ratings(raw), required)
    return named.withColumns({c: F.col(c).try_cast(t) for c, t in NUMBER_COLUMNS.items() if c in named.columns})


def read_topics(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Topic lookup with the headings ``AI topic`` and ``Topics``."""
    raw = read_delimited(spark, path, multi_line=multi_line)
    return raw.select(F.col("AI topic").try_cast("int").alias("flag"), F.col("Topics").alias("topic"))


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the visible entries of a folder on any file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def read_category_results(spark: SparkSession, folder: str, pattern: str | None = None, *, multi_line: bool = False) -> DataFrame:
    """Per-category result files as one long table; the category comes from the name.

    There is one entry per category. Year columns may differ between entries: the
    result has the union of years.
    """
    parts = []
    for entry in list_names(spark, folder):
        stem = entry.removeprefix(NAME_PREFIX).removesuffix(".csv")
        if pattern and pattern not in stem:
            continue
        wide = rename_ratings(read_delimited(spark, f"{folder.rstrip('/')}/{entry}", multi_line=multi_line))
        wide = require_columns(wide, [c for c in RATING_NAMES.values() if c in ("soc_code", "title", "task", "scale_name", "data_value")])
        years = year_columns(wide)
        typed = wide.withColumns({"data_value": F.col("data_value").try_cast("double"), **{y: F.col(f"`{y}`").try_cast("double").try_cast("long") for y in years}})
        parts.append(years_to_long(typed, years=years).withColumn("ai_category", category_from_name(F.lit(stem))))
    if not parts:
        raise FileNotFoundError(f"no result files in {folder}")
    return concat_results(parts)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Saved ``(id, vec)`` rows."""
    return require_columns(spark.read.parquet(path), ["id", "vec"])
