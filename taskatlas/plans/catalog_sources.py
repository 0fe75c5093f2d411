"""Queries that write a table to shared storage and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskatlas.operators import embedding, reshape
from taskatlas.operators.columns import RATING_NAMES
from taskatlas.plans.registry import query
from taskatlas.plans.views import (
    COUNTS_SQL,
    DOCS_SQL,
    FIRST_YEAR,
    LAST_YEAR,
    RATINGS_SQL,
    VECTORS_SQL,
    YEARS,
    documents,
    ratings,
    table,
    task_counts,
    vectors,
    with_sql,
)
from taskatlas.sources import readers, writers
from taskatlas.sources.storage import scratch_dir

_DOC_COLUMNS = "application_id, application_title, application_abstract, year, topic_label"


def _documents(spark, sf):
    return documents(spark, sf).select(*readers.DOCUMENT_SCHEMA.names)


@query("s1_read_documents", with_sql(DOCS_SQL, f"SELECT DISTINCT {_DOC_COLUMNS} FROM docs"))
def _(spark, sf):
    path = scratch_dir(spark, "documents") + ".csv"
    docs = _documents(spark, sf)
    # Every row twice: the reader drops the copies.
    writers.save_table(docs.unionAll(docs), path)
    return readers.read_documents(spark, path, multi_line=True)


@query("s2_read_tsv", with_sql(DOCS_SQL, f"SELECT {_DOC_COLUMNS} FROM docs"))
def _(spark, sf):
    path = scratch_dir(spark, "documents") + ".tsv"
    writers.save_table(_documents(spark, sf), path)
    return readers.read_delimited(spark, path, readers.DOCUMENT_SCHEMA, multi_line=True)


@query("s1_read_documents_split", with_sql(DOCS_SQL, f"SELECT DISTINCT {_DOC_COLUMNS} FROM docs"))
def _(spark, sf):
    """Line breaks in fields and no reading of whole files by one task."""
    path = scratch_dir(spark, "documents") + ".csv"
    docs = _documents(spark, sf)
    writers.save_table(docs.unionAll(docs), path)
    return readers.read_documents(spark, path)


@query("s2_read_tsv_split", with_sql(DOCS_SQL, f"SELECT {_DOC_COLUMNS} FROM docs"))
def _(spark, sf):
    path = scratch_dir(spark, "documents") + ".tsv"
    writers.save_table(_documents(spark, sf), path)
    return readers.read_delimited(spark, path, readers.DOCUMENT_SCHEMA)


@query(
    "s3_read_ratings",
    with_sql(RATINGS_SQL, "SELECT task_id, task, title, soc_code, scale_name, task_category, data_value FROM ratings"),
)
def _(spark, sf):
    path = scratch_dir(spark, "ratings") + ".csv"
    headings = ratings(spark, sf).withColumnsRenamed({v: k for k, v in RATING_NAMES.items()})
    writers.save_table(headings.select(*[f"`{h}`" for h in RATING_NAMES]), path)
    return readers.read_ratings(spark, path)


def _results(spark, sf):
    """Wide results of one category per entry, as written by a matching run."""
    keys = ["soc_code", "title", "task", "scale_name", "task_category", "data_value", "ai_category"]
    counts = task_counts(spark, sf).withColumn("ai_category", F.concat(F.lit("Flag "), "ai_category"))
    wide = reshape.long_to_wide(counts, keys, "year", YEARS, F.sum("matches"))
    folder = scratch_dir(spark, "results")
    writers.write_by_category(wide, folder, first_year=FIRST_YEAR, last_year=LAST_YEAR, threshold=0.75)
    return folder


@query(
    "s4_category_results",
    with_sql(
        COUNTS_SQL,
        "SELECT soc_code, title, task, data_value, 'flag_' || lower(ai_category) AS ai_category, year, matches FROM counts",
    ),
)
def _(spark, sf):
    long = readers.read_category_results(spark, _results(spark, sf))
    return long.filter(F.col("matches").isNotNull()).select("soc_code", "title", "task", "data_value", "ai_category", "year", "matches")


@query("s6_save_parquet", with_sql(RATINGS_SQL, "SELECT * FROM ratings"))
def _(spark, sf):
    path = scratch_dir(spark, "ratings") + ".parquet"
    writers.save_table(ratings(spark, sf), path)
    return readers.read_ratings(spark, path)


@query(
    "s7_write_by_category",
    with_sql(
        COUNTS_SQL,
        f"""SELECT 'AI_{FIRST_YEAR}to{LAST_YEAR}_abstractTitleFor_flag_' || lower(ai_category) || '_0.75' AS name, count(*) AS rows
           FROM (SELECT DISTINCT soc_code, task, ai_category FROM counts) GROUP BY ai_category""",
    ),
)
def _(spark, sf):
    folder = _results(spark, sf)
    return spark.read.options(**readers.CSV_READ).csv(folder).groupBy("name").agg(F.count("*").alias("rows"))


@query(
    "s8_save_embeddings",
    with_sql(VECTORS_SQL, "SELECT id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, round(unnest(vec), 6) AS value FROM vectors"),
)
def _(spark, sf):
    path = scratch_dir(spark, "embeddings")
    writers.save_embeddings(vectors(spark, sf), path)
    long = readers.read_embeddings(spark, path).select("id", F.posexplode("vec").alias("dim", "value"))
    return long.withColumn("value", F.round("value", 6))


@query(
    "s8_embedding_metadata",
    """SELECT count(*) AS num_texts, 64 AS embedding_dim,
         (SELECT string_agg(text, chr(10) ORDER BY doc_id) FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5)) AS sample_texts FROM documents""",
)
def _(spark, sf):
    encoded = embedding.encode_text(table(spark, sf, "documents"), "text", width=64)
    found = embedding.embedding_metadata(encoded, "vec", "text", "doc_id")
    return found.withColumn("sample_texts", F.array_join("sample_texts", "\n"))
