"""Queries that run a stream to its end and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskatlas.plans.catalog_vectors import TEXT_LABELS_SQL, definition_vectors
from taskatlas.plans.registry import query
from taskatlas.plans.runs import label_run
from taskatlas.plans.views import table, with_sql
from taskatlas.sources.storage import scratch_dir
from taskatlas.streaming import incremental


def _stream(spark, sf, name):
    """The table's files as a stream; the pattern covers one file and a folder of files."""
    return incremental.file_stream(spark, f"{sf}/{name}*.parquet", table(spark, sf, name).schema)


def _documents_of(stream):
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return stream.select(
        F.col("doc_id").alias("application_id"),
        F.trim(first).alias("application_title"),
        F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("application_abstract"),
    )


@query(
    "i1_label_stream",
    with_sql(TEXT_LABELS_SQL, "SELECT application_id, category, round(confidence, 6) AS confidence FROM text_labels"),
)
def _(spark, sf):
    categories = definition_vectors(spark)
    out, state = scratch_dir(spark, "labels"), scratch_dir(spark, "labels-state")

    def label(docs):
        done = label_run(_documents_of(docs), categories)
        return done.select("application_id", "category", F.round("confidence", 6).alias("confidence"))

    incremental.label_stream(_stream(spark, sf, "documents"), label, out, state)
    return spark.read.parquet(out)


@query("i2_resume_stream", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def _(spark, sf):
    """Two runs over the same input and checkpoint: the second adds nothing."""
    out, state = scratch_dir(spark, "events"), scratch_dir(spark, "events-state")
    for _run in range(2):
        incremental.run_append(_stream(spark, sf, "events").select("event_id", "event_type"), out, state)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("i3_running_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(spark, sf):
    out, state = scratch_dir(spark, "totals"), scratch_dir(spark, "totals-state")
    totals = _stream(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    incremental.run_totals(totals, out, state)
    return incremental.latest_totals(spark, out).withColumn("total", F.round("total", 4))
