"""Queries over vectors: encoding, pooling, measures, matching, classification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.vectors import METRICS, metric, normalise
from taskatlas.operators import classify, embedding, filters, similarity, vector_index
from taskatlas.operators.exposure import task_matches
from taskatlas.operators.joins import spread_join
from taskatlas.operators.reports import match_quality, similarity_distribution
from taskatlas.plans.catalog_text import COMBINED_SQL, clean_sql
from taskatlas.plans.registry import query
from taskatlas.plans.runs import label_run
from taskatlas.plans.views import (
    DOC_CATEGORIES,
    DOC_YEARS,
    DOCS_SQL,
    LABELS_SQL,
    MEANS_SQL,
    VECTORS_SQL,
    documents,
    label_means,
    queries_of,
    table,
    vectors,
    with_sql,
)
from taskatlas.sources.storage import scratch_dir, stored

WIDTH = 64
THRESHOLD = 0.3
COUNT_CAP = 3
ROUND = 6

_ENTRIES_SQL = "CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, unnest(vec) AS value"


def _entries(df, *keys):
    """One row per vector element, so that results compare value by value."""
    long = df.select(*keys, F.posexplode("vec").alias("dim", "value"))
    return long.withColumn("value", F.round("value", ROUND))


def _definitions_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', '{d}')" for i, (n, d) in enumerate(classify.CATEGORIES))
    return f"definitions(cat_pos, category, description) AS (VALUES {rows})"


def encode_sql(source: str, id_col: str, text: str, out: str) -> str:
    """CTEs that encode ``text`` of ``source`` as (id, bucket, value) rows of unit vectors."""
    return f"""{out}_tok AS (
  SELECT {id_col} AS id, unnest(string_split(lower({clean_sql(text)}), ' ')) AS t FROM {source}),
{out}_cnt AS (
  SELECT id, CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % {WIDTH} AS bucket, CAST(count(*) AS DOUBLE) AS c
  FROM {out}_tok WHERE t <> '' GROUP BY ALL),
{out} AS (
  SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS value FROM {out}_cnt)"""


# ------------------------------------------------------------------ encoding


@query(
    "v1_encode_text",
    with_sql(
        DOCS_SQL + ", " + encode_sql("docs", "application_id", "text", "enc"),
        f"SELECT id AS application_id, CAST(bucket AS INTEGER) AS dim, round(value, {ROUND}) AS value FROM enc",
    ),
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("application_id"), "text")
    return _entries(embedding.encode_text(docs, "text", width=WIDTH), "application_id").filter(F.col("value") != 0)


@query(
    "v1_encode_with",
    with_sql(
        DOCS_SQL + ", " + encode_sql("docs", "application_id", "text", "enc"),
        f"SELECT id AS application_id, CAST(bucket AS INTEGER) AS dim, round(value, {ROUND}) AS value FROM enc",
    ),
)
def _(spark, sf):
    """The way for outside models, with the hashed words as the model."""

    def make():
        def encode(texts):
            out = np.zeros((len(texts), WIDTH))
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    out[i, embedding.token_bucket(word, WIDTH)] += 1.0
            return out

        return encode

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("application_id"), "text")
    return _entries(embedding.encode_with(docs, "text", make, width=WIDTH), "application_id").filter(F.col("value") != 0)


def _tokens(spark, sf):
    """Eight tokens of eight elements per vector; a token is masked when its first element is negative."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vec", i * 8 + 1, 8))).alias("pos", "vec")
    rows = vectors(spark, sf).select(F.col("id").alias("doc_id"), at)
    return rows.withColumn("mask", (F.get("vec", F.lit(0)) >= 0).cast("int"))


_TOKENS_SQL = (
    VECTORS_SQL
    + """, tok AS (
  SELECT id AS doc_id, pos, list_slice(vec, pos * 8 + 1, pos * 8 + 8) AS v FROM vectors CROSS JOIN range(8) r(pos)),
el AS (SELECT doc_id, pos, CASE WHEN v[1] >= 0 THEN 1 ELSE 0 END AS mask,
         unnest(v) AS x, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim FROM tok)"""
)


@query(
    "v2_pool_mean",
    with_sql(_TOKENS_SQL, "SELECT doc_id, dim, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) AS value FROM el GROUP BY ALL"),
)
def _(spark, sf):
    return _entries(embedding.pool_tokens(_tokens(spark, sf), how="mean"), "doc_id")


@query("v2_pool_cls", with_sql(_TOKENS_SQL, "SELECT doc_id, dim, round(arg_min(x, pos), 6) AS value FROM el GROUP BY ALL"))
def _(spark, sf):
    return _entries(embedding.pool_tokens(_tokens(spark, sf), how="cls"), "doc_id")


@query(
    "v2_pool_max",
    with_sql(_TOKENS_SQL, "SELECT doc_id, dim, round(max(CASE WHEN mask = 0 THEN -1e9 ELSE x END), 6) AS value FROM el GROUP BY ALL"),
)
def _(spark, sf):
    return _entries(embedding.pool_tokens(_tokens(spark, sf), how="max"), "doc_id")


@query(
    "v3_normalise",
    with_sql(
        VECTORS_SQL + f""", scaled AS (SELECT id, list_transform(list_transform(vec, lambda x: x * 3.0), lambda x: x) AS v FROM vectors),
        done AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS vec FROM scaled)""",
        f"SELECT id, dim, round(value, {ROUND}) AS value FROM (SELECT id, {_ENTRIES_SQL} FROM done)",
    ),
)
def _(spark, sf):
    scaled = F.transform("vec", lambda x: x * 3.0)
    return _entries(vectors(spark, sf).select("id", normalise(scaled).alias("vec")), "id")


@query(
    "v4_blank_vectors",
    with_sql(
        DOCS_SQL + ", " + encode_sql("docs", "application_id", "application_abstract", "enc"),
        """SELECT d.application_id, round(coalesce(sum(value * value), 0.0), 6) AS squared, 64 AS width
           FROM docs d LEFT JOIN enc e ON d.application_id = e.id GROUP BY ALL""",
    ),
)
def _(spark, sf):
    docs = embedding.encode_text(documents(spark, sf), "application_abstract", width=WIDTH)
    docs = embedding.blank_to_zero(docs, "application_abstract", "vec", WIDTH)
    squared = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return docs.select("application_id", F.round(squared, ROUND).alias("squared"), F.size("vec").alias("width"))


# ------------------------------------------------------------------ measures

_PAIR_SQL = MEANS_SQL + ", pairs AS (SELECT v.id, v.vec AS a, m.vec AS b FROM vectors v JOIN means m USING (label))"
_MEASURES_SQL = {
    "cosine": "list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))",
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))",
    "dot": "list_inner_product(a, b)",
}


def _own_mean(spark, sf):
    """Each vector beside the mean vector of its label."""
    docs = vectors(spark, sf).select("id", "label", "vec")
    means = embedding.class_means(docs, "label").withColumnRenamed("vec", "mean")
    return spread_join(docs, means, ["label"])


def _measure_query(name, key):
    @query(key, with_sql(_PAIR_SQL, f"SELECT id, round({_MEASURES_SQL[name]}, {ROUND}) AS {name} FROM pairs"))
    def _(spark, sf):
        value = METRICS[name](F.col("vec"), F.col("mean"))
        return _own_mean(spark, sf).select("id", F.round(value, ROUND).alias(name))


for _name, _key in (("cosine", "v5_cosine"), ("euclidean", "v6_euclidean"), ("manhattan", "v7_manhattan"), ("dot", "v8_dot")):
    _measure_query(_name, _key)


@query(
    "v9_metric_by_name",
    with_sql(
        _PAIR_SQL,
        " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({s}), {ROUND}) AS mean_value FROM pairs" for n, s in _MEASURES_SQL.items()),
    ),
)
def _(spark, sf):
    pairs = _own_mean(spark, sf)
    means = pairs.agg(*[F.round(F.avg(metric(n)(F.col("vec"), F.col("mean"))), ROUND).alias(n) for n in METRICS])
    return means.unpivot([], list(METRICS), "metric", "mean_value")


# ------------------------------------------------------------------ matching

_SIMS_SQL = VECTORS_SQL + """, sims AS (
  SELECT q.id AS qid, d.id, d.category, d.year, round(list_inner_product(q.u, d.u), 9) AS sim FROM unit q CROSS JOIN unit d)"""


@query("f8_similar_pairs", with_sql(_SIMS_SQL, f"SELECT qid, id, round(sim, {ROUND}) AS sim FROM sims WHERE sim >= {THRESHOLD}"))
def _(spark, sf):
    docs = vectors(spark, sf)
    pairs = similarity.similar_pairs(queries_of(docs), docs, threshold=THRESHOLD)
    return filters.at_least(pairs, "sim", THRESHOLD).select("qid", "id", F.round("sim", ROUND).alias("sim"))


@query(
    "j2_similarity_join",
    with_sql(_SIMS_SQL, f"SELECT qid, category, id, round(sim, {ROUND}) AS sim FROM sims WHERE sim >= {THRESHOLD} AND category <> 'unknown'"),
)
def _(spark, sf):
    docs = vectors(spark, sf)
    valid = docs.filter(filters.valid_category(F.col("category")))
    pairs = similarity.similar_pairs(queries_of(docs), valid, threshold=THRESHOLD, keys=["category"])
    return pairs.withColumn("sim", F.round("sim", ROUND))


@query("f1_valid_category", with_sql(VECTORS_SQL, "SELECT id, category, year FROM vectors WHERE category IS NOT NULL AND category <> 'unknown'"))
def _(spark, sf):
    return filters.filter_documents(vectors(spark, sf), category_col="category").select("id", "category", "year")


@query(
    "v10_category_similarity",
    with_sql(
        MEANS_SQL,
        """SELECT v.id, m.category,
             round(round(list_inner_product(v.vec, m.vec) / greatest(sqrt(list_inner_product(v.vec, v.vec)), 1e-9), 9), 6) AS sim
           FROM vectors v CROSS JOIN means m""",
    ),
)
def _(spark, sf):
    scores = classify.category_scores(vectors(spark, sf), label_means(spark, sf))
    return scores.withColumn("sim", F.round("sim", ROUND))


@query(
    "v11_top_for_query",
    with_sql(
        VECTORS_SQL,
        f"""SELECT id, round(sim, {ROUND}) AS sim FROM (
              SELECT v.id, round(list_inner_product(v.vec, q.vec), 9) AS sim
              FROM vectors v CROSS JOIN (SELECT vec FROM vectors ORDER BY id LIMIT 1) q)
            ORDER BY sim DESC, id LIMIT 10""",
    ),
)
def _(spark, sf):
    docs = vectors(spark, sf)
    target = docs.select("id", "vec").orderBy("id").first()["vec"]
    return similarity.top_k_for(docs, target, k=10).withColumn("sim", F.round("sim", ROUND))


def _top_sql(k: int, keys: str = "") -> str:
    part = f"qid{keys}"
    return with_sql(
        _SIMS_SQL,
        f"""SELECT {part}, CAST(rank AS INTEGER) AS rank, id, round(sim, {ROUND}) AS sim FROM (
              SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY sim DESC, id) AS rank FROM sims) WHERE rank <= {k}""",
    )


@query("v12_top_k", _top_sql(10))
def _(spark, sf):
    docs = vectors(spark, sf)
    return similarity.top_k(queries_of(docs), docs, k=10).withColumn("sim", F.round("sim", ROUND))


@query("v12_top_k_by_year", _top_sql(5, ", year"))
def _(spark, sf):
    docs = vectors(spark, sf)
    return similarity.top_k(queries_of(docs), docs, k=5, keys=["year"]).withColumn("sim", F.round("sim", ROUND))


# The way of large query sides, on small data: some ranges and lanes.
GRID = similarity.Plan(resident_bytes=0, range_rows=512, lane_rows=64)


@query("v12_top_k_blocked", _top_sql(10))
def _(spark, sf):
    """The way taken when the query side does not fit in memory."""
    docs = vectors(spark, sf)
    return similarity.top_k(queries_of(docs), docs, k=10, plan=GRID).withColumn("sim", F.round("sim", ROUND))


@query("v12_top_k_by_year_blocked", _top_sql(5, ", year"))
def _(spark, sf):
    docs = vectors(spark, sf)
    return similarity.top_k(queries_of(docs), docs, k=5, keys=["year"], plan=GRID).withColumn("sim", F.round("sim", ROUND))


@query("f8_similar_pairs_blocked", with_sql(_SIMS_SQL, f"SELECT qid, id, round(sim, {ROUND}) AS sim FROM sims WHERE sim >= {THRESHOLD}"))
def _(spark, sf):
    docs = vectors(spark, sf)
    return similarity.similar_pairs(queries_of(docs), docs, threshold=THRESHOLD, plan=GRID).select("qid", "id", F.round("sim", ROUND).alias("sim"))


@query(
    "a7_match_counts_blocked",
    with_sql(_SIMS_SQL, f"SELECT qid, category, year, least({COUNT_CAP}, count(*)) AS matches FROM sims WHERE sim >= {THRESHOLD} AND category <> 'unknown' GROUP BY ALL"),
)
def _(spark, sf):
    docs = vectors(spark, sf)
    valid = docs.filter(filters.valid_category(F.col("category")))
    return similarity.match_counts(queries_of(docs), valid, threshold=THRESHOLD, k=COUNT_CAP, plan=GRID)


# Two-stage search as configured by default (250 scored exactly), on leaves for small tables.
LEAVES, SEARCHED, SHORTLIST = 16, 8, 250


def _index(spark, docs: DataFrame, **settings) -> vector_index.VectorIndex:
    return vector_index.build_index(docs, scratch_dir(spark, "vector-index"), **({"leaves": LEAVES, "copies": 2} | settings))


def _with_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The rows with the share of each query's exact neighbours that were found."""
    hits = exact.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    shares = hits.groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), ROUND).alias("recall"))
    return found.join(shares, "qid").withColumn("sim", F.round("sim", ROUND))


def _compared(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Rows found, scores that differ from the exact ones, and whether recall reaches 0.9."""
    both = found.join(exact.select("qid", "id", F.col("sim").alias("true_sim")), ["qid", "id"], "left")
    wrong = F.count_if(F.abs(F.col("sim") - F.col("true_sim")) > 1e-6)
    return both.agg(F.count("*").alias("n_rows"), wrong.alias("wrong_scores"), (F.count("true_sim") >= 0.9 * F.count("*")).alias("recall_holds"))


def _compared_sql(k: int, extra: str = "") -> str:
    return with_sql(
        _SIMS_SQL,
        f"""SELECT least({k}, (SELECT count(DISTINCT id) FROM sims)) * count(DISTINCT qid) AS n_rows, CAST(0 AS BIGINT) AS wrong_scores,
              true AS recall_holds{extra} FROM sims""",
    )


@query("v13_approximate_top_k")
def _(spark, sf):
    """Two-stage search with the recall of each query against the exact neighbours."""
    docs = vectors(spark, sf)
    queries = queries_of(docs)
    found = vector_index.search_index(_index(spark, docs), queries, k=10, leaves_to_search=SEARCHED, shortlist=SHORTLIST)
    return _with_recall(found, similarity.top_k(queries, docs, k=10))


@query("v13_recall", _compared_sql(10))
def _(spark, sf):
    docs = vectors(spark, sf)
    queries = queries_of(docs)
    found = vector_index.search_index(_index(spark, docs), queries, k=10, leaves_to_search=SEARCHED, shortlist=SHORTLIST)
    return _compared(found, similarity.top_k(queries, docs, k=10))


@query("v13_recall_configured", _compared_sql(100))
def _(spark, sf):
    """Recall with 200 leaves, 100 of them searched, 250 in the shortlist and 100 neighbours."""
    docs = vectors(spark, sf)
    queries = queries_of(docs)
    found = vector_index.search_index(_index(spark, docs, leaves=200, codes=256), queries, k=100, leaves_to_search=100, shortlist=SHORTLIST)
    return _compared(found, similarity.top_k(queries, docs, k=100))


@query("v13_recall_by_year", with_sql(
    _SIMS_SQL,
    """SELECT CAST(sum(least(5, n)) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS wrong_scores, true AS recall_holds
       FROM (SELECT qid, year, count(*) AS n FROM sims GROUP BY ALL)""",
))
def _(spark, sf):
    """Neighbours of each year from one index that holds the year of its documents."""
    docs = vectors(spark, sf)
    queries = queries_of(docs)
    found = vector_index.search_index(_index(spark, docs.select("id", "vec", "year"), keys=["year"]), queries, k=5, leaves_to_search=SEARCHED, shortlist=SHORTLIST, keys=["year"])
    return _compared(found, similarity.top_k(queries, docs, k=5, keys=["year"]))


@query("v13_index_grows", with_sql(
    _SIMS_SQL,
    """, early AS (SELECT * FROM sims WHERE id % 3 <> 0 AND qid % 2 = 0), late AS (SELECT * FROM sims WHERE qid % 2 = 1)
       SELECT least(10, (SELECT count(DISTINCT id) FROM early)) * (SELECT count(DISTINCT qid) FROM early) AS n_early,
              least(10, (SELECT count(DISTINCT id) FROM late)) * (SELECT count(DISTINCT qid) FROM late) AS n_late,
              CAST(0 AS BIGINT) AS wrong_scores, true AS recall_holds""",
))
def _(spark, sf):
    """One index: searched, opened again, grown by a third of the documents, searched by other queries."""
    docs = vectors(spark, sf).select("id", "vec")
    first, rest = docs.filter(F.col("id") % 3 != 0), docs.filter(F.col("id") % 3 == 0)
    even, odd = (queries_of(docs).filter(F.col("qid") % 2 == i) for i in (0, 1))
    settings = {"k": 10, "leaves_to_search": SEARCHED, "shortlist": SHORTLIST}
    index = _index(spark, first)
    early = stored(vector_index.search_index(index, even, **settings), "early-neighbours")
    again = vector_index.open_index(spark, index.path)
    vector_index.append_documents(again, rest)
    late = vector_index.search_index(again, odd, **settings)
    a, b = _compared(early, similarity.top_k(even, first, k=10)), _compared(late, similarity.top_k(odd, docs, k=10))
    both = a.select(F.col("n_rows").alias("n_early"), F.lit(0).cast("long").alias("n_late"), "wrong_scores", "recall_holds").unionByName(
        b.select(F.lit(0).cast("long").alias("n_early"), F.col("n_rows").alias("n_late"), "wrong_scores", "recall_holds")
    )
    return both.agg(*[F.sum(c).alias(c) for c in ("n_early", "n_late", "wrong_scores")], F.every("recall_holds").alias("recall_holds"))


@query("v12_top_k_pruned", _top_sql(10))
def _(spark, sf):
    """Exact neighbours from the index; leaves that cannot hold one are passed over."""
    docs = vectors(spark, sf)
    found, _ = vector_index.exact_search(_index(spark, docs, copies=1), queries_of(docs), k=10)
    return found.withColumn("sim", F.round("sim", ROUND))


@query("v13_all_leaves", _top_sql(10))
def _(spark, sf):
    docs = vectors(spark, sf)
    found = similarity.approximate_top_k(queries_of(docs), docs, k=10, leaves=16, leaves_to_search=16)
    return found.withColumn("sim", F.round("sim", ROUND))


@query("v14_pca")
def _(spark, sf):
    projected, share = embedding.reduce_dimensions(vectors(spark, sf), "id", n_components=8)
    return _entries(projected, "id").withColumn("explained", F.lit(round(share, ROUND)))


@query(
    "v14_pca_full_width",
    with_sql(
        VECTORS_SQL + """, long AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vectors),
middle AS (SELECT i, avg(x) AS m FROM long GROUP BY i)""",
        "SELECT id, round(sum((x - m) * (x - m)), 4) AS squared_length, CAST(1.0 AS DOUBLE) AS explained FROM long JOIN middle USING (i) GROUP BY id",
    ),
)
def _(spark, sf):
    """All components keep the length of the centred vector."""
    projected, share = embedding.reduce_dimensions(vectors(spark, sf), "id", n_components=WIDTH)
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return projected.select("id", F.round(length, 4).alias("squared_length"), F.lit(round(share, ROUND)).alias("explained"))


@query("v15_width", with_sql(VECTORS_SQL, "SELECT CAST(max(len(vec)) AS INTEGER) AS width FROM vectors"))
def _(spark, sf):
    return embedding.embedding_width(vectors(spark, sf))


@query(
    "r3_neighbour_lists",
    with_sql(
        _SIMS_SQL,
        """SELECT qid, year, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS neighbours FROM (
             SELECT *, row_number() OVER (PARTITION BY qid, year ORDER BY sim DESC, id) AS rank FROM sims)
           WHERE rank <= 5 GROUP BY qid, year""",
    ),
)
def _(spark, sf):
    docs = vectors(spark, sf)
    lists = similarity.neighbour_lists(similarity.top_k(queries_of(docs), docs, k=5, keys=["year"]), ["year"])
    ids = F.transform("neighbours", lambda n: n["id"].cast("string"))
    return lists.select("qid", "year", F.array_join(ids, ",").alias("neighbours"))


def _vector_ratings(docs):
    """One importance rating per vector, for fanning out match counts."""
    return docs.select(
        F.concat(F.lit("S"), "label").alias("soc_code"),
        F.concat(F.lit("Title "), "label").alias("title"),
        F.concat(F.lit("task "), "id").alias("task"),
        F.lit("Importance").alias("scale_name"),
        (F.lit(1.0) + F.col("label") * 0.4).alias("data_value"),
    )


def matched_vectors(spark, sf, *, k=COUNT_CAP):
    """Match counts of every task for all categories and years."""
    docs = vectors(spark, sf)
    valid = docs.filter(filters.valid_category(F.col("category")))
    counts = similarity.match_counts(queries_of(docs), valid, threshold=THRESHOLD, k=k)
    named = counts.select(F.concat(F.lit("task "), "qid").alias("task"), "category", "year", "matches")
    return task_matches(_vector_ratings(docs), named, DOC_CATEGORIES, DOC_YEARS)


MATCHED_SQL = _SIMS_SQL + f""", found AS (
  SELECT qid, category, year, least({COUNT_CAP}, count(*)) AS matches FROM sims
  WHERE sim >= {THRESHOLD} AND category <> 'unknown' GROUP BY ALL),
slots AS (SELECT 'c' || c AS ai_category, CAST(y AS INTEGER) AS year FROM range(8) a(c) CROSS JOIN range(2021, 2026) b(y)),
matched AS (
  SELECT 'S' || v.label AS soc_code, 'Title ' || v.label AS title, 'task ' || v.id AS task, 'Importance' AS scale_name,
         1.0 + v.label * CAST(0.4 AS DOUBLE) AS data_value, s.ai_category, s.year, coalesce(f.matches, 0) AS matches
  FROM vectors v CROSS JOIN slots s LEFT JOIN found f ON f.qid = v.id AND f.category = s.ai_category AND f.year = s.year)"""


@query("a7_match_counts", with_sql(MATCHED_SQL, "SELECT soc_code, task, ai_category, year, matches FROM matched"))
def _(spark, sf):
    return matched_vectors(spark, sf).select("soc_code", "task", "ai_category", "year", "matches")


@query(
    "a5_similarity_distribution",
    with_sql(
        _SIMS_SQL,
        f"""SELECT round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, round(min(sim), 6) AS min, round(max(sim), 6) AS max,
              round(quantile_cont(sim, 0.5), 6) AS median, round(quantile_cont(sim, 0.25), 6) AS q1, round(quantile_cont(sim, 0.75), 6) AS q3
            FROM sims WHERE sim >= {THRESHOLD}""",
    ),
)
def _(spark, sf):
    docs = vectors(spark, sf)
    return similarity_distribution(similarity.similar_pairs(queries_of(docs), docs, threshold=THRESHOLD))


@query(
    "a6_match_quality",
    with_sql(
        _SIMS_SQL,
        f"""SELECT round(avg(sim), 6) AS mean_similarity, count(*) FILTER (sim > 0.8) AS high_matches,
              count(DISTINCT v.label) AS covered, (SELECT count(DISTINCT label) FROM vectors) AS occupations,
              round(count(DISTINCT v.label) / (SELECT count(DISTINCT label) FROM vectors), 6) AS coverage
            FROM sims s JOIN vectors v ON v.id = s.qid WHERE sim >= {THRESHOLD}""",
    ),
)
def _(spark, sf):
    docs = vectors(spark, sf)
    pairs = similarity.similar_pairs(queries_of(docs), docs, threshold=THRESHOLD)
    owners = docs.select(F.col("id").alias("qid"), F.concat(F.lit("S"), "label").alias("soc_code"))
    return match_quality(spread_join(pairs, owners, ["qid"]), _vector_ratings(docs))


# ------------------------------------------------------------ classification


def labelled(spark, sf):
    return classify.classify(vectors(spark, sf), label_means(spark, sf))


@query("c1_zero_shot", with_sql(LABELS_SQL, f"SELECT id, category, round(confidence, {ROUND}) AS confidence FROM labelled"))
def _(spark, sf):
    return labelled(spark, sf).select("id", "category", F.round("confidence", ROUND).alias("confidence"))


@query("j3_nearest_category", with_sql(LABELS_SQL, "SELECT id, category FROM labelled"))
def _(spark, sf):
    best = classify.nearest_category(F.col("vec"), label_means(spark, sf))
    return vectors(spark, sf).select("id", best["category"].alias("category"))


def definition_vectors(spark):
    """The category definitions, encoded like the documents."""
    defined = embedding.encode_text(classify.category_table(spark), "description", width=WIDTH)
    return classify.category_vectors(defined)


TEXT_LABELS_SQL = (
    DOCS_SQL + f", {_definitions_sql()}, "
    + f"texts AS (SELECT application_id, {COMBINED_SQL} AS combined FROM docs), "
    + encode_sql("texts", "application_id", "combined", "enc") + ", "
    + encode_sql("definitions", "cat_pos", "description", "def")
    + """, dots AS (
  SELECT e.id, f.id AS cat_pos, sum(e.value * f.value) AS sim FROM enc e JOIN def f USING (bucket) GROUP BY ALL),
every AS (
  SELECT t.application_id, t.combined, c.cat_pos, c.category, round(coalesce(d.sim, 0.0), 9) AS sim
  FROM texts t CROSS JOIN definitions c LEFT JOIN dots d ON d.id = t.application_id AND d.cat_pos = c.cat_pos),
text_labels AS (
  SELECT application_id, CASE WHEN combined = '' THEN 'missing_data' ELSE category END AS category,
         CASE WHEN combined = '' THEN 0.0 ELSE sim END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY sim DESC, cat_pos) AS rn FROM every) WHERE rn = 1)"""
)


@query(
    "c1_zero_shot_text",
    with_sql(TEXT_LABELS_SQL, f"SELECT application_id, category, round(confidence, {ROUND}) AS confidence FROM text_labels"),
)
def _(spark, sf):
    done = label_run(documents(spark, sf), definition_vectors(spark))
    return done.select("application_id", "category", F.round("confidence", ROUND).alias("confidence"))


@query(
    "a25_validation",
    with_sql(
        LABELS_SQL,
        """SELECT c.category, count(*) FILTER (truth = c.category) AS support,
             round(count(*) FILTER (truth = c.category AND l.category = c.category) / nullif(count(*) FILTER (l.category = c.category), 0), 6) AS precision,
             round(count(*) FILTER (truth = c.category AND l.category = c.category) / nullif(count(*) FILTER (truth = c.category), 0), 6) AS recall,
             round(avg(CASE WHEN truth = l.category THEN 1.0 ELSE 0.0 END), 6) AS accuracy
           FROM labelled l CROSS JOIN (SELECT DISTINCT category FROM means) c GROUP BY c.category""",
    ),
)
def _(spark, sf):
    return classify.validation(labelled(spark, sf), "truth", "category")


@query(
    "a25_confusion",
    with_sql(LABELS_SQL, "SELECT truth, category AS predicted, count(*) AS n FROM labelled GROUP BY ALL"),
)
def _(spark, sf):
    return classify.confusion(labelled(spark, sf), "truth", "category")
