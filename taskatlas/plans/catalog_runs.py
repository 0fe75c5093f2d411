"""Queries for whole runs: text in, neighbours, labels or exposure out."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskatlas.operators.classify import CATEGORIES
from taskatlas.plans.catalog_vectors import TEXT_LABELS_SQL, definition_vectors, encode_sql
from taskatlas.plans.registry import query
from taskatlas.plans.runs import attach_neighbours, ensemble_run, exposure_run, label_run, neighbours_by_year
from taskatlas.plans.views import DOC_YEARS, DOCS_SQL, RATINGS_SQL, documents, ratings, table, with_sql

NAMES = tuple(name for name, _ in CATEGORIES)
THRESHOLD = 0.2
CAP = 50
NEIGHBOURS = 5


def _ratings(spark, sf):
    """Ratings whose task text is the part name, shared by many rating rows."""
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), "p_name")
    return ratings(spark, sf).join(names, "task_id").withColumn("task", F.col("p_name")).drop("p_name")


_TASKS_SQL = "tasks AS (SELECT DISTINCT p_name AS task FROM part), " + encode_sql("tasks", "task", "task", "tenc")

_NEAR_SQL = DOCS_SQL + ", " + _TASKS_SQL + ", " + encode_sql("docs", "application_id", "application_title", "title") + f""", near AS (
  SELECT t.task, d.application_id AS id, d.year, round(coalesce(s.sim, 0.0), 9) AS sim
  FROM tasks t CROSS JOIN docs d LEFT JOIN (
    SELECT e.id AS id, f.id AS task, sum(e.value * f.value) AS sim FROM title e JOIN tenc f USING (bucket) GROUP BY ALL) s
  ON s.task = t.task AND s.id = d.application_id),
ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY task, year ORDER BY sim DESC, id) AS INTEGER) AS rank FROM near) WHERE rank <= {NEIGHBOURS})"""


@query("run_neighbours_by_year", with_sql(_NEAR_SQL, "SELECT task, year, rank, id, round(sim, 6) AS sim FROM ranked"))
def _(spark, sf):
    ranked = neighbours_by_year(documents(spark, sf), _ratings(spark, sf), k=NEIGHBOURS)
    return ranked.withColumn("sim", F.round("sim", 6))


@query(
    "run_attached_neighbours",
    with_sql(
        _NEAR_SQL + ", lists AS (SELECT task, year, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM ranked GROUP BY task, year)",
        "SELECT p_partkey AS task_id, p_name AS task, "
        + ", ".join(f"max(ids) FILTER (year = {y}) AS neighbours_{y}" for y in DOC_YEARS)
        + " FROM part LEFT JOIN lists ON task = p_name GROUP BY ALL",
    ),
)
def _(spark, sf):
    rows = _ratings(spark, sf).select("task_id", "task")
    ranked = neighbours_by_year(documents(spark, sf), rows, k=NEIGHBOURS)
    wide = attach_neighbours(rows, ranked, DOC_YEARS)
    ids = {f"neighbours_{y}": F.array_join(F.transform(f"neighbours_{y}", lambda n: n["id"].cast("string")), ",") for y in DOC_YEARS}
    return wide.withColumns(ids)


@query(
    "run_labels_resumed",
    with_sql(
        TEXT_LABELS_SQL,
        """SELECT d.application_id, d.year, CASE WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE t.category END AS category,
             CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE round(t.confidence, 6) END AS confidence
           FROM docs d JOIN text_labels t USING (application_id) LEFT JOIN labels l ON l.doc_id = d.application_id WHERE d.year >= 2022""",
    ),
)
def _(spark, sf):
    done = table(spark, sf, "labels").select(
        F.col("doc_id").alias("application_id"), F.lit("kept").alias("category"), F.lit(1.0).alias("confidence")
    )
    rows = label_run(documents(spark, sf), definition_vectors(spark), start_year=2022, done=done)
    return rows.select("application_id", "year", "category", F.round("confidence", 6).alias("confidence"))


@query(
    "run_ensemble",
    """WITH three AS (
         SELECT d.doc_id AS id, CASE WHEN d.n_chars > 1000 THEN '1' ELSE '0' END AS a, CAST(l.quality AS VARCHAR) AS b, CAST(l.toxic AS VARCHAR) AS c
         FROM documents d JOIN labels l USING (doc_id)),
       counted AS (SELECT id, a, CAST((a = '1')::INT + (b = '1')::INT + (c = '1')::INT AS BIGINT) AS ones FROM three)
       SELECT id, CASE WHEN ones >= 2 THEN '1' ELSE '0' END AS ensemble_category, CAST(0.5 AS DOUBLE) AS ensemble_confidence, greatest(ones, 3 - ones) AS ensemble_votes
       FROM counted WHERE greatest(ones, 3 - ones) >= 2""",
)
def _(spark, sf):
    labels = table(spark, sf, "labels").withColumn("confidence", F.lit(0.5))
    first = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("category"), F.lit(0.5).alias("confidence")
    )
    inputs = [first, labels.select("doc_id", F.col("quality").alias("category"), "confidence"), labels.select("doc_id", F.col("toxic").alias("category"), "confidence")]
    return ensemble_run(inputs, id_col="doc_id", min_votes=2)


_RUN_SQL = TEXT_LABELS_SQL + ", " + RATINGS_SQL + ", " + _TASKS_SQL + f""", sims AS (
  SELECT f.id AS task, l.category, d.year, l.application_id, round(sum(e.value * f.value), 9) AS sim
  FROM enc e JOIN tenc f USING (bucket) JOIN text_labels l ON l.application_id = e.id JOIN docs d ON d.application_id = e.id GROUP BY ALL),
found AS (
  SELECT task, category, year, least({CAP}, count(*)) AS matches FROM sims WHERE sim >= {THRESHOLD} AND category <> 'missing_data' GROUP BY ALL),
slots AS (SELECT category, CAST(y AS INTEGER) AS year FROM definitions CROSS JOIN range(2021, 2026) r(y)),
matched AS (
  SELECT r.soc_code, r.title, r.scale_name, r.data_value, s.category, s.year, coalesce(f.matches, 0) AS matches
  FROM ratings r JOIN part p ON p.p_partkey = r.task_id CROSS JOIN slots s
  LEFT JOIN found f ON f.task = p.p_name AND f.category = s.category AND f.year = s.year)"""


@query(
    "run_exposure",
    with_sql(
        _RUN_SQL,
        """SELECT soc_code, title, category AS ai_category, year, CASE WHEN sum(matches) = 0 THEN 0.0
             ELSE CAST(round_even(CAST(sum(matches * data_value) / sum(matches) AS DECIMAL(18, 9)), 4) AS DOUBLE) END AS exposure
           FROM matched WHERE scale_name = 'Importance' GROUP BY ALL""",
    ),
)
def _(spark, sf):
    docs = documents(spark, sf)
    labels = label_run(docs, definition_vectors(spark), years=DOC_YEARS, keep_vectors=True)
    return exposure_run(labels, _ratings(spark, sf), NAMES, DOC_YEARS, threshold=THRESHOLD, k=CAP)
