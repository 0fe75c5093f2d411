"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskatlas.llm import collocations, contamination, filter_audit, inner_product, language, notices, packing, parity_join, pseudonyms, quality, suffix_tree, toxicity, url_filter
from taskatlas.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage."""

    def add(fn: Query) -> Query:
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return add


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""


@query("op1_top_products", OP1_SQL)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", inner_product.quantized(F.col("embedding")).alias("q"))
    return inner_product.top_products(vectors, "vec_id", "q", F.col("vec_id") % 20 == 0, k=20)


@query("op3_judge_urls")
def _(spark, sf):
    return url_filter.judge_urls(table(spark, sf, "pages"), "page_id", "url", rules=url_filter.RULES)


OP7_SQL = r"""
WITH item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS size
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM win),
place AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM doc, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)
), hit AS (SELECT r, i, win.size, item_id FROM place JOIN win ON place.win = win.win AND place.size = win.size),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN ids USING (r)
"""


@query("op7_contamination", OP7_SQL)
def _(spark, sf):
    found = contamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")




@query("op9_notices")
def _(spark, sf):
    """Labels of phrases and of notices found with errors; the score is the best similarity."""
    found = notices.scan_notices(table(spark, sf, "documents"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    fuzzy = F.transform("notices", lambda n: n["label"])
    best = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda n: n["similarity"])), F.lit(0.0)))
    starts = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, fuzzy))), ",").alias("labels"),
        F.round(best, 6).alias("score"),
    )


@query("op5_language")
def _(spark, sf):
    documents = table(spark, sf, "documents")
    labelled = documents.filter(~language.held_out()).select("doc_id", "text", F.col("lang").alias("label"))
    found = language.identify_languages(documents, labelled)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op10_quality")
def _(spark, sf):
    """Grades: 0 poor, 1 fair writing that is toxic, 2 fair."""
    ratings = table(spark, sf, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("label"))
    return quality.grade_documents(table(spark, sf, "documents"), ratings)


@query("op4_toxicity")
def _(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score_toxicity(table(spark, sf, "documents"), labels).drop("evidence")


@query("op8_pack")
def _(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=2048)

# The key of the example queries; a real run passes its own.
EXAMPLE_KEY = "taskatlas example key"


@query("op2_pseudonyms")
def _(spark, sf):
    """The new texts, how many values each kind had and the sorted pseudonyms."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    found = pseudonyms.private_values(F.col("text"))
    rows = documents.select("doc_id", found.alias("found"), pseudonyms.pseudonymized(F.col("text"), EXAMPLE_KEY).alias("text"))
    counts = [F.size(F.filter("found", pseudonyms.is_kind(k))).cast("long").alias(f"n_{k}") for k in pseudonyms.KINDS]
    return rows.select("doc_id", "text", F.size("found").cast("long").alias("n_values"), *counts)


OP6_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN len(w) || ' ' || array_to_string(w, ' ') ELSE '5 ' || array_to_string(w[i:i + 4], ' ') END AS s
  FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, least(doc.doc_id, coalesce(least_id, doc.doc_id)) AS component_id
FROM doc LEFT JOIN n ON n.doc_id = doc.doc_id LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = doc.doc_id
"""


@query("op6_components", OP6_SQL)
def _(spark, sf):
    return parity_join.jaccard_components(table(spark, sf, "documents"))


OP12_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), good AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), fail AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc.doc_id > min(doc.doc_id) OVER (PARTITION BY t), false)} AS f
  FROM doc LEFT JOIN good ON good.doc_id = doc.doc_id
), cell AS (
  SELECT part, CAST(f.A AS INTEGER) + 2 * CAST(f.B AS INTEGER) + 4 * CAST(f.C AS INTEGER) + 8 * CAST(f.D AS INTEGER) + 16 * CAST(f.E AS INTEGER) AS mask,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM fail GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ord AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), step AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS INTEGER) AS earlier
  FROM ord, (SELECT unnest(range(1, 6)) AS step)
), counts AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counts
"""


@query("op12_filter_audit", OP12_SQL)
def _(spark, sf):
    return filter_audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, (SELECT unnest(range(1, 6)) AS k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL
), cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.a, s.i, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cand c, unnest(range(1, c.k)) AS s(i)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:s.i], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[s.i + 1:], ' ')
  JOIN total ON total.lang = c.lang
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (
  SELECT c.lang, array_to_string(c.w[s.i:s.i + z.size - 1], ' ') AS phrase, max(c.a) AS longer
  FROM cand c, unnest(range(2, c.k)) AS z(size), unnest(range(1, c.k - z.size + 2)) AS s(i) GROUP BY ALL
)
SELECT * FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r,
         CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM best b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def _(spark, sf):
    return collocations.mine_collocations(table(spark, sf, "documents"))


@query("op11_suffix_tree")
def _(spark, sf):
    return suffix_tree.score_language(table(spark, sf, "documents"))
