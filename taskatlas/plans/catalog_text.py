"""Queries over documents and task texts: preparation, filters, duplicates, joins on ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskatlas.functions.text import (
    PROMPT_ABSTRACT,
    PROMPT_HEAD,
    PROMPT_TAIL,
    PROMPT_TITLE,
    WHITE_CLASS_FLAT,
    WHITE_POINTS,
    category_title,
    clean_text,
    combine_text,
    normalise_response,
    prompt,
    result_name,
    shorten,
)
from taskatlas.operators import columns, dedup, filters, joins
from taskatlas.operators.classify import PROMPT_CATEGORIES
from taskatlas.operators.filters import kept_report
from taskatlas.plans.registry import query
from taskatlas.plans.views import COUNTS_SQL, DOCS_SQL, RATINGS_SQL, documents, ratings, table, task_counts, with_sql

_CHARS = " || ".join(f"chr({p})" for p in WHITE_POINTS)
_RESPONSES = ("EN", "de", "fr")


def clean_sql(col: str) -> str:
    return f"trim(regexp_replace(coalesce({col}, ''), '{WHITE_CLASS_FLAT}+', ' ', 'g'))"


def _joined_sql() -> str:
    return "coalesce(application_title, '') || '. ' || coalesce(application_abstract, '')"


COMBINED_SQL = f"CASE WHEN trim({_joined_sql()}, {_CHARS}) = '.' THEN '' ELSE trim({_joined_sql()}, {_CHARS}) END"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- projection


@query("p1_clean_text", f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


@query("p2_title_fallback", with_sql(DOCS_SQL, "SELECT application_id, application_title FROM docs"))
def _(spark, sf):
    renamed = documents(spark, sf).withColumnRenamed("application_title", "patent_title")
    return columns.with_title(renamed).select("application_id", "application_title")


@query("p3_id_fallback", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS application_id FROM documents")
def _(spark, sf):
    return columns.with_id(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "application_id")


@query(
    "p4_year",
    """SELECT o_orderkey, CAST(year(try_cast(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP))
       AS INTEGER) AS year FROM orders""",
)
def _(spark, sf):
    dated = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filing_date"),
    )
    return columns.with_year(dated).select("o_orderkey", "year")


@query("p5_defaults", "SELECT doc_id, 'Machine Learning' AS topic_label, source AS title FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return columns.with_default(columns.with_default(docs, "topic_label", columns.DEFAULT_TOPIC), "title", columns.DEFAULT_OCCUPATION)


@query("p6_task_fallback", with_sql(RATINGS_SQL, f"SELECT task_id AS id, {clean_sql('task')} AS task, 'Occupation' AS title FROM ratings"))
def _(spark, sf):
    renamed = ratings(spark, sf).select(F.col("task_id").alias("id"), F.col("task").alias("Main Task Text"))
    return columns.prepare_tasks(renamed).select("id", "task", "title")


@query("p7_combined_text", with_sql(DOCS_SQL, f"SELECT application_id, {COMBINED_SQL} AS combined FROM docs"))
def _(spark, sf):
    text = combine_text(F.col("application_title"), F.col("application_abstract"))
    return documents(spark, sf).select("application_id", text.alias("combined"))


@query(
    "p8_combined_variants",
    with_sql(DOCS_SQL, f"SELECT application_id, trim({_joined_sql()}, {_CHARS}) AS stripped, {_joined_sql()} AS plain FROM docs"),
)
def _(spark, sf):
    title, abstract = F.col("application_title"), F.col("application_abstract")
    return documents(spark, sf).select(
        "application_id",
        combine_text(title, abstract, empty_rule=False).alias("stripped"),
        combine_text(title, abstract, empty_rule=False, strip_ends=False).alias("plain"),
    )


@query("p9_result_columns", with_sql(RATINGS_SQL, "SELECT soc_code, title, task, scale_name, task_category, data_value FROM ratings"))
def _(spark, sf):
    return ratings(spark, sf).select(*columns.RESULT_COLUMNS)


@query(
    "p10_prompt",
    with_sql(
        DOCS_SQL,
        "SELECT application_id, "
        + _text(PROMPT_HEAD + "\n".join(f"- {n}: {d}" for n, d in PROMPT_CATEGORIES) + PROMPT_TITLE)
        + f" || coalesce(application_title, '') || {_text(PROMPT_ABSTRACT)} || coalesce(application_abstract, '') || {_text(PROMPT_TAIL)}"
        + " AS prompt FROM docs",
    ),
)
def _(spark, sf):
    text = prompt(F.col("application_title"), F.col("application_abstract"), PROMPT_CATEGORIES)
    return documents(spark, sf).select("application_id", text.alias("prompt"))


@query(
    "p11_responses",
    with_sql(
        DOCS_SQL,
        """SELECT application_id,
             CASE WHEN coalesce(application_title, '') = '' AND coalesce(application_abstract, '') = '' THEN 'missing_data'
                  WHEN source = 'src0' THEN 'classification_failed'
                  WHEN topic_label = 'en' THEN 'EN' WHEN topic_label IN ('de', 'fr') THEN topic_label
                  ELSE 'unknown' END AS category FROM docs""",
    ),
)
def _(spark, sf):
    response = F.when(F.col("source") != "src0", F.concat(F.lit("  "), F.upper("topic_label"), F.lit("\n")))
    label = normalise_response(response, F.col("application_title"), F.col("application_abstract"), _RESPONSES)
    return documents(spark, sf).select("application_id", label.alias("category"))


@query(
    "p12_short_labels",
    with_sql(
        DOCS_SQL,
        """SELECT application_id,
             CASE WHEN length(application_title) > 40 THEN substring(application_title, 1, 40) || '...' ELSE application_title END AS short,
             CASE WHEN length(application_title) > 60 THEN substring(application_title, 1, 60) || '...' ELSE application_title END AS medium
           FROM docs""",
    ),
)
def _(spark, sf):
    title = F.col("application_title")
    return documents(spark, sf).select("application_id", shorten(title, 40).alias("short"), shorten(title, 60).alias("medium"))


@query(
    "p13_category_labels",
    r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || ' x-ray*' || p_type, '\p{L}+|[^\p{L}]+'),
         lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), '') AS label FROM part""",
)
def _(spark, sf):
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_x-ray*"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", category_title(slug).alias("label"))


@query(
    "s7_result_names",
    """SELECT p_partkey, 'AI_2021to2025_abstractTitleFor_' || lower(replace(replace(p_name || '*', ' ', '_'), '*', '')) || '_0.75' AS name FROM part""",
)
def _(spark, sf):
    name = result_name(F.concat("p_name", F.lit("*")), F.lit(2021), F.lit(2025), 0.75)
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


# ------------------------------------------------------------------- filters


@query(
    "f2_topic_filter",
    with_sql(
        DOCS_SQL,
        """SELECT application_id, topic_label FROM docs WHERE topic_label IN (
             SELECT topic_label FROM docs GROUP BY topic_label HAVING avg(length(text)) < (SELECT avg(length(text)) FROM docs))""",
    ),
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    # Topics whose documents are shorter than the mean are flagged.
    mean = docs.agg(F.avg(F.length("text"))).scalar()
    topics = docs.groupBy(F.col("lang").alias("topic")).agg((F.avg(F.length("text")) < mean).cast("int").alias("flag"))
    return filters.filter_documents(documents(spark, sf), topics=topics).select("application_id", "topic_label")


@query("f3_no_filter", with_sql(DOCS_SQL, "SELECT application_id, year FROM docs"))
def _(spark, sf):
    return filters.filter_documents(documents(spark, sf)).select("application_id", "year")


@query("f4_in_year", with_sql(DOCS_SQL, "SELECT application_id, source, year FROM docs WHERE year = 2023"))
def _(spark, sf):
    return filters.in_year(documents(spark, sf), 2023).select("application_id", "source", "year")


@query(
    "f5_from_year",
    with_sql(DOCS_SQL, "SELECT application_id, year FROM docs WHERE source <> 'src19' AND year >= 2023"),
)
def _(spark, sf):
    text_year = F.when(F.col("source") == "src19", "no year").otherwise(F.concat(F.col("year").cast("string"), F.lit(".0")))
    docs = documents(spark, sf).withColumn("year", text_year)
    return filters.from_year(docs, 2023).select("application_id", "year")


@query("f6_first_year_column", with_sql(DOCS_SQL, "SELECT application_id, year AS filing_year FROM docs WHERE year >= 2024"))
def _(spark, sf):
    docs = documents(spark, sf).select("application_id", F.col("year").alias("filing_year"), F.lit(1999).alias("grant_year"))
    return filters.from_first_year_column(docs, 2024).drop("grant_year")


@query("f7_importance", with_sql(COUNTS_SQL, "SELECT soc_code, task, ai_category, year, matches FROM imp"))
def _(spark, sf):
    return filters.importance_only(task_counts(spark, sf)).select("soc_code", "task", "ai_category", "year", "matches")


@query("f11_text_present", with_sql(DOCS_SQL, f"SELECT application_id, {clean_sql('application_abstract')} AS abstract FROM docs"))
def _(spark, sf):
    cleaned = documents(spark, sf).select("application_id", clean_text(F.col("application_abstract")).alias("abstract"))
    return filters.text_present(cleaned, "abstract")


@query("f12_task_search", with_sql(RATINGS_SQL, "SELECT task_id, task FROM ratings WHERE task ILIKE '%RED%' OR task ILIKE '%blue%'"))
def _(spark, sf):
    return filters.task_contains(ratings(spark, sf), "RED|blue").select("task_id", "task")


@query(
    "a26_kept_report",
    with_sql(
        COUNTS_SQL,
        """SELECT count(*) AS rows_before, count(*) FILTER (scale_name = 'Importance') AS rows_after,
             round(100.0 * count(*) FILTER (scale_name = 'Importance') / count(*), 4) AS kept_percent FROM counts""",
    ),
)
def _(spark, sf):
    return kept_report(task_counts(spark, sf), F.col("scale_name") == "Importance")


# ---------------------------------------------------------------- duplicates


@query("d1_drop_identical", "SELECT DISTINCT lang, text FROM documents")
def _(spark, sf):
    return dedup.drop_identical(table(spark, sf, "documents").select("lang", "text"))


@query(
    "d2_keep_first",
    """SELECT l_orderkey, l_partkey, l_linenumber FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(spark, sf):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return dedup.keep_first(table(spark, sf, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_linenumber")


@query("d2_keep_first_text", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _(spark, sf):
    return dedup.keep_first_text(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")


@query("d3_distinct_tasks", "SELECT p_name AS task, min(p_partkey) AS first_seen FROM part GROUP BY p_name")
def _(spark, sf):
    return dedup.distinct_tasks(table(spark, sf, "part").withColumnRenamed("p_name", "task"), "p_partkey")


@query(
    "d4_id_overlap",
    """SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS in_both,
         count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only
       FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
)
def _(spark, sf):
    return dedup.id_overlap(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "d5_concat",
    """SELECT doc_id, lang, n_chars, CAST(NULL AS INTEGER) AS quality FROM documents
       UNION ALL SELECT doc_id, NULL, NULL, quality FROM labels""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return dedup.concat_results([docs, table(spark, sf, "labels").select("doc_id", "quality")])


# --------------------------------------------------------------- joins on ids


@query(
    "j5_fan_out",
    with_sql(
        RATINGS_SQL,
        """, per_name AS (SELECT p_name AS task, count(*) AS matches FROM lineitem JOIN part ON l_partkey = p_partkey
             WHERE l_returnflag = 'R' GROUP BY p_name)
           SELECT p_partkey AS task_id, p_name AS task, coalesce(matches, 0) AS matches
           FROM part LEFT JOIN per_name ON p_name = task""",
    ),
)
def _(spark, sf):
    part = table(spark, sf, "part")
    returned = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").groupBy("l_partkey").agg(F.count("*").alias("n"))
    per_name = returned.join(part, returned["l_partkey"] == part["p_partkey"]).groupBy(F.col("p_name").alias("task")).agg(F.sum("n").alias("matches"))
    rows = part.select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("task"))
    return joins.fan_out_counts(rows, per_name)


@query(
    "j6_update_merge",
    """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END AS topic, coalesce(l.quality, -1) AS quality
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"), F.lit(-1).alias("quality"))
    right = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("topic"), "quality")
    return joins.update_merge(left, right, "doc_id")


@query("j7_remaining", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return joins.remaining(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")
