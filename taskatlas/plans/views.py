"""The analytics inputs as views over the test tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskatlas.operators.classify import CategoryVectors, category_vectors
from taskatlas.operators.embedding import class_means

FIRST_YEAR, LAST_YEAR = 1995, 2001
YEARS = tuple(range(FIRST_YEAR, LAST_YEAR + 1))
FLAGS = ("A", "N", "R")
DOC_YEARS = (2021, 2022, 2023, 2024, 2025)
DOC_CATEGORIES = tuple(f"c{i}" for i in range(8))
# Five models: ranges of the vector's dimensions.
MODELS = (("full", 0, 64), ("low", 0, 32), ("high", 32, 64), ("middle", 16, 48), ("head", 0, 16))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating rows: one task per part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("task_id"),
        F.col("p_brand").alias("soc_code"),
        F.concat(F.lit("Title "), F.col("p_brand")).alias("title"),
        F.concat(F.col("p_name"), F.lit(" #"), key.cast("string")).alias("task"),
        F.when(F.col("p_type") == "PROMO", "Frequency").otherwise("Importance").alias("scale_name"),
        F.when(F.col("p_type").isin("STANDARD", "MEDIUM", "LARGE"), "Core").otherwise("Supplemental").alias("task_category"),
        (F.lit(1.0) + ((F.col("p_size") - 1) % 41) / 10.0).alias("data_value"),
    )


def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match counts per rating row, category and year.

    Line items are counted per part before the join, so the join moves counts.
    """
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.col("l_returnflag").alias("ai_category"), F.year("l_shipdate").alias("year"))
        .agg(F.count("*").alias("matches"))
    )
    rows = ratings(spark, sf_dir)
    return counted.join(rows, counted["l_partkey"] == rows["task_id"]).select(
        "soc_code", "title", "task", "scale_name", "task_category", "data_value", "ai_category", "year", "matches"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the first line is the title, the rest the abstract."""
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    rest = F.substring(F.col("text"), F.length(first) + 2, F.length("text"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("application_id"),
        F.trim(first).alias("application_title"),
        F.nullif(rest, F.lit("")).alias("application_abstract"),
        (F.lit(2021) + F.floor(F.substring("source", 4, 10).cast("int") / 4)).cast("int").alias("year"),
        F.col("lang").alias("topic_label"),
        "source",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document vectors with a category and a year."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
        F.concat(F.lit("c"), label).alias("truth"),
        F.when(label < 8, F.concat(F.lit("c"), label)).when(label == 8, "unknown").alias("category"),
        (F.lit(2021) + F.col("vec_id") % 5).cast("int").alias("year"),
    )


def queries_of(docs: DataFrame) -> DataFrame:
    """The same vectors on the query side of a match."""
    return docs.select(F.col("id").alias("qid"), "vec")


def label_means(spark: SparkSession, sf_dir: str, *, unit: bool = True) -> CategoryVectors:
    """Mean vector per label as category vectors, in label order."""
    means = class_means(vectors(spark, sf_dir), "label", unit=unit)
    return category_vectors(means.select(F.col("label").alias("cat_pos"), F.concat(F.lit("c"), "label").alias("category"), "vec"))


# ------------------------------------------------------------------ SQL twins

RATINGS_SQL = """ratings AS (
  SELECT p_partkey AS task_id, p_brand AS soc_code, 'Title ' || p_brand AS title,
         p_name || ' #' || CAST(p_partkey AS VARCHAR) AS task,
         CASE WHEN p_type = 'PROMO' THEN 'Frequency' ELSE 'Importance' END AS scale_name,
         CASE WHEN p_type IN ('STANDARD', 'MEDIUM', 'LARGE') THEN 'Core' ELSE 'Supplemental' END AS task_category,
         CAST(1.0 + ((p_size - 1) % 41) / 10.0 AS DOUBLE) AS data_value
  FROM part)"""

COUNTS_SQL = RATINGS_SQL + """, counts AS (
  SELECT soc_code, title, task, scale_name, task_category, data_value, l_returnflag AS ai_category,
         CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS matches
  FROM lineitem JOIN ratings ON l_partkey = task_id GROUP BY ALL),
imp AS (SELECT * FROM counts WHERE scale_name = 'Importance')"""

EXPOSURE_SQL = COUNTS_SQL + """, exposed AS (
  SELECT soc_code, title, ai_category, year,
         CASE WHEN sum(matches) = 0 THEN 0.0
              ELSE CAST(round_even(CAST(sum(matches * data_value) / sum(matches) AS DECIMAL(18, 9)), 4) AS DOUBLE) END AS exposure
  FROM imp GROUP BY ALL)"""

DOCS_SQL = """docs AS (
  SELECT doc_id AS application_id, trim(split_part(text, chr(10), 1)) AS application_title,
         nullif(substring(text, length(split_part(text, chr(10), 1)) + 2), '') AS application_abstract,
         CAST(2021 + CAST(substring(source, 4) AS INTEGER) // 4 AS INTEGER) AS year, lang AS topic_label, source, text
  FROM documents)"""

VECTORS_SQL = """vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label, 'c' || label AS truth,
         CASE WHEN label < 8 THEN 'c' || label WHEN label = 8 THEN 'unknown' END AS category,
         CAST(2021 + vec_id % 5 AS INTEGER) AS year
  FROM embeddings),
unit AS (
  SELECT *, list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-10)) AS u FROM vectors)"""

MEANS_SQL = VECTORS_SQL + """, long AS (
  SELECT id, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vectors),
raw_means AS (
  SELECT label, list(m ORDER BY i) AS vec FROM (SELECT label, i, avg(x) AS m FROM long GROUP BY label, i) GROUP BY label),
means AS (
  SELECT label, 'c' || label AS category,
         list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS vec FROM raw_means)"""

LABELS_SQL = MEANS_SQL + """, labelled AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT v.id, v.truth, v.year, m.category, round(list_inner_product(v.vec, m.vec), 9) AS confidence,
           row_number() OVER (PARTITION BY v.id ORDER BY round(list_inner_product(v.vec, m.vec), 9) DESC, m.label) AS rn
    FROM vectors v CROSS JOIN means m) WHERE rn = 1)"""

PREDICTIONS_SQL = MEANS_SQL + """, models(model_pos, model, lo, hi) AS (
  VALUES (0, 'full', 1, 64), (1, 'low', 1, 32), (2, 'high', 33, 64), (3, 'middle', 17, 48), (4, 'head', 1, 16)),
model_means AS (
  SELECT model_pos, model, lo, hi, label, list_slice(vec, lo, hi) AS v FROM raw_means CROSS JOIN models),
model_docs AS (
  SELECT id, truth, model_pos, list_slice(vec, lo, hi) AS v FROM vectors CROSS JOIN models),
model_sims AS (
  SELECT d.id, d.truth, m.model_pos, m.model, m.label,
         round(list_inner_product(d.v, m.v) / (sqrt(list_inner_product(d.v, d.v)) * sqrt(list_inner_product(m.v, m.v))), 9) AS sim
  FROM model_docs d JOIN model_means m USING (model_pos)),
predictions AS (
  SELECT id, truth, model_pos, model, 'c' || label AS category, sim AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY id, model_pos ORDER BY sim DESC, label) AS rn FROM model_sims) WHERE rn = 1)"""


def vote_sql(source: str, weight: str = "1", ids: str = "vectors") -> str:
    """CTEs that vote over ``source`` for every id of ``ids``."""
    return f"""tally AS (
  SELECT id, category, CAST(sum({weight}) AS BIGINT) AS votes,
         round(sum(confidence * {weight}) / sum({weight}), 12) AS conf, min(model_pos) AS first
  FROM {source} WHERE category IS NOT NULL AND confidence IS NOT NULL GROUP BY id, category),
winners AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, conf DESC, first) AS rn FROM tally) WHERE rn = 1),
voted AS (
  SELECT i.id, w.category AS ensemble_category, w.conf AS ensemble_confidence, coalesce(w.votes, 0) AS ensemble_votes
  FROM (SELECT DISTINCT id FROM {ids}) i LEFT JOIN winners w USING (id))"""


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
