"""Queries over several models' labels: votes, agreement, distribution reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from taskatlas.operators import ensemble, filters, reports
from taskatlas.operators.classify import classify_models
from taskatlas.operators.joins import compare_results
from taskatlas.plans.catalog_vectors import labelled
from taskatlas.plans.registry import query
from taskatlas.plans.views import DOC_CATEGORIES, LABELS_SQL, MODELS, PREDICTIONS_SQL, VECTORS_SQL, label_means, table, vectors, vote_sql, with_sql

ROUND = 6
NAMES = [m[0] for m in MODELS]
SUBSET = ["full", "low", "high"]
# Predictions under this confidence count as missing in the c4 query.
MISSING_BELOW = 0.25
_OUT = "id, ensemble_category, round(ensemble_confidence, 6) AS ensemble_confidence, ensemble_votes"
VOTED_SQL = PREDICTIONS_SQL + ", " + vote_sql("predictions")


def predicted(spark, sf):
    """Five models' predictions, one row per document."""
    return classify_models(vectors(spark, sf), MODELS, label_means(spark, sf, unit=False)).select("id", "truth", "predictions")


def voted(spark, sf):
    return ensemble.vote_rows(predicted(spark, sf))


def _out(df):
    return df.select("id", "ensemble_category", F.round("ensemble_confidence", ROUND).alias("ensemble_confidence"), "ensemble_votes")


@query("c2_models", with_sql(PREDICTIONS_SQL, "SELECT id, model_pos, model, category, round(confidence, 6) AS confidence FROM predictions"))
def _(spark, sf):
    return ensemble.predictions_long(predicted(spark, sf)).withColumn("confidence", F.round("confidence", ROUND))


@query(
    "c2_models_wide",
    with_sql(
        PREDICTIONS_SQL,
        "SELECT id, "
        + ", ".join(
            f"max(category) FILTER (model = '{m}') AS {m}_category, round(max(confidence) FILTER (model = '{m}'), 6) AS {m}_confidence" for m in NAMES
        )
        + " FROM predictions GROUP BY id",
    ),
)
def _(spark, sf):
    wide = ensemble.wide_models(ensemble.predictions_long(predicted(spark, sf)), NAMES)
    return wide.withColumns({f"{m}_confidence": F.round(f"{m}_confidence", ROUND) for m in NAMES})


@query("c3_vote", with_sql(VOTED_SQL, f"SELECT {_OUT} FROM voted"))
def _(spark, sf):
    return _out(voted(spark, sf))


@query("c3_vote_long", with_sql(VOTED_SQL, f"SELECT {_OUT} FROM voted"))
def _(spark, sf):
    return _out(ensemble.vote_long(ensemble.predictions_long(predicted(spark, sf))))


_SPARSE_SQL = (
    PREDICTIONS_SQL
    + f""", sparse AS (SELECT id, model_pos, CASE WHEN confidence >= {MISSING_BELOW} THEN category END AS category, confidence FROM predictions), """
    + vote_sql("sparse")
)


@query("c4_vote_missing", with_sql(_SPARSE_SQL, f"SELECT {_OUT} FROM voted"))
def _(spark, sf):
    def blank_weak(p):
        return p.withField("category", F.when(p["confidence"] >= MISSING_BELOW, p["category"]))

    sparse = predicted(spark, sf).withColumn("predictions", F.transform("predictions", blank_weak))
    return _out(ensemble.vote_rows(sparse))


_WEIGHTED_SQL = (
    PREDICTIONS_SQL
    + ", weighted AS (SELECT *, CASE WHEN model = 'full' THEN 2 ELSE 1 END AS weight FROM predictions), "
    + vote_sql("weighted", "weight")
)


@query("c5_weighted_vote", with_sql(_WEIGHTED_SQL, f"SELECT {_OUT} FROM voted"))
def _(spark, sf):
    weighted = predicted(spark, sf).withColumn(
        "predictions", F.transform("predictions", lambda p: p.withField("weight", F.when(p["model"] == "full", 2).otherwise(1)))
    )
    return _out(ensemble.vote_rows(weighted, weighted=True))


_SUBSET_SQL = (
    PREDICTIONS_SQL
    + ", subset AS (SELECT * FROM predictions WHERE model IN ('full', 'low', 'high')), "
    + vote_sql("subset")
)


@query("c6_model_subset", with_sql(_SUBSET_SQL, f"SELECT {_OUT} FROM voted"))
def _(spark, sf):
    return _out(ensemble.vote_rows(ensemble.pick_models(predicted(spark, sf), SUBSET)))


_HYBRID_SQL = VOTED_SQL + """, first AS (SELECT id, category, confidence FROM predictions WHERE model = 'full'),
hybrid AS (
  SELECT f.id, CASE WHEN f.confidence < 0.5 THEN coalesce(v.ensemble_category, f.category) ELSE f.category END AS category,
         CASE WHEN f.confidence < 0.5 THEN coalesce(v.ensemble_confidence, f.confidence) ELSE f.confidence END AS confidence
  FROM first f JOIN voted v USING (id))"""


def _of_model(name):
    return F.get(F.filter("predictions", lambda p: p["model"] == name), F.lit(0))


def _single(df, name="full"):
    mine = _of_model(name)
    return df.select("id", mine["category"].alias("category"), mine["confidence"].alias("confidence"))


@query("c7_hybrid", with_sql(_HYBRID_SQL, "SELECT id, category, round(confidence, 6) AS confidence FROM hybrid"))
def _(spark, sf):
    done = voted(spark, sf)
    second = done.select("id", F.col("ensemble_category").alias("category"), F.col("ensemble_confidence").alias("confidence"))
    merged = ensemble.relabel_low_confidence(_single(done), second, "id")
    return merged.withColumn("confidence", F.round("confidence", ROUND))


@query(
    "j1_combine_models",
    """WITH ids AS (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings)
       SELECT doc_id AS id, 0 AS model_pos, 'base' AS model, lang AS category, CAST(n_chars AS DOUBLE) AS confidence FROM documents WHERE doc_id IN (FROM ids)
       UNION ALL SELECT doc_id, 1, 'quality', CAST(quality AS VARCHAR), CAST(toxic AS DOUBLE) FROM labels WHERE doc_id IN (FROM ids)
       UNION ALL SELECT vec_id, 2, 'model_3', CAST(label AS VARCHAR), NULL FROM embeddings WHERE vec_id IN (FROM ids)""",
)
def _(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("ai_category"), F.col("n_chars").alias("confidence"))
    quality = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("category"), F.col("toxic").alias("ai_category_confidence"))
    third = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("predicted_category"))
    return ensemble.combine_models([base, quality, third], ["base", "quality"], "doc_id").drop("weight")


@query(
    "j1_combine_wide",
    """SELECT d.doc_id AS id, d.source, d.text, d.lang AS base_category, CAST(d.n_chars AS DOUBLE) AS base_confidence,
              CAST(l.quality AS VARCHAR) AS quality_category, CAST(l.toxic AS DOUBLE) AS quality_confidence
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, sf):
    """The merged table with the base's own columns."""
    base = table(spark, sf, "documents").select("doc_id", "source", "text", F.col("lang").alias("ai_category"), F.col("n_chars").alias("confidence"))
    quality = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("category"), F.col("toxic").alias("ai_category_confidence"))
    wide = ensemble.wide_models(ensemble.combine_models([base, quality], ["base", "quality"], "doc_id"), ["base", "quality"])
    return ensemble.with_base(wide, base.drop("ai_category", "confidence"), "doc_id")


# ----------------------------------------------------------------- agreement


def _wide(df):
    """Model label columns beside the vote, taken from the array without a shuffle."""
    return df.select(
        "*", *[_of_model(m)["category"].alias(f"{m}_category") for m in NAMES]
    )


_WIDE_SQL = (
    VOTED_SQL
    + ", wide AS (SELECT id, "
    + ", ".join(f"max(category) FILTER (model = '{m}') AS {m}_category" for m in NAMES)
    + " FROM predictions GROUP BY id), merged AS (SELECT * FROM wide JOIN voted USING (id))"
)


@query(
    "a21_pair_agreement",
    with_sql(
        _WIDE_SQL,
        " UNION ALL ".join(
            f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(avg(CASE WHEN {a}_category = {b}_category THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM wide"
            for a, b in combinations(NAMES, 2)
        ),
    ),
)
def _(spark, sf):
    return ensemble.pair_agreement(_wide(predicted(spark, sf)), NAMES)


@query(
    "a22_agreement_levels",
    with_sql(
        VOTED_SQL,
        """SELECT count(*) AS total, count(*) FILTER (ensemble_votes >= 4) AS high,
             round(100.0 * count(*) FILTER (ensemble_votes >= 4) / count(*), 4) AS high_percent,
             count(*) FILTER (ensemble_votes <= 3) AS low,
             round(100.0 * count(*) FILTER (ensemble_votes <= 3) / count(*), 4) AS low_percent FROM voted""",
    ),
)
def _(spark, sf):
    return ensemble.agreement_levels(voted(spark, sf))


@query(
    "a23_full_disagreement",
    with_sql(
        PREDICTIONS_SQL,
        """SELECT id, string_agg(category, ',' ORDER BY category) AS labels FROM predictions GROUP BY id
           HAVING count(DISTINCT category) = 5""",
    ),
)
def _(spark, sf):
    rows = ensemble.full_disagreement(predicted(spark, sf), len(MODELS))
    return rows.withColumn("labels", F.array_join("labels", ","))


@query(
    "a24_against_single",
    with_sql(
        _WIDE_SQL,
        """SELECT count(*) AS total, count(*) FILTER (full_category <> ensemble_category) AS different,
             round(count(*) FILTER (full_category <> ensemble_category) / count(*), 6) AS different_share,
             round(count(*) FILTER (ensemble_votes >= 4 AND full_category = ensemble_category) / nullif(count(*) FILTER (ensemble_votes >= 4), 0), 6)
               AS strong_agreement FROM merged""",
    ),
)
def _(spark, sf):
    return ensemble.against_single(_wide(voted(spark, sf)), "full_category", "ensemble_category", "ensemble_votes")


@query(
    "a24_differing_rows",
    with_sql(_WIDE_SQL, "SELECT id, full_category, ensemble_category, ensemble_votes FROM merged WHERE full_category <> ensemble_category"),
)
def _(spark, sf):
    rows = ensemble.differing_rows(_wide(voted(spark, sf)), "full_category", "ensemble_category")
    return rows.select("id", "full_category", "ensemble_category", "ensemble_votes")


@query(
    "j8_compare_results",
    with_sql(
        VOTED_SQL,
        """SELECT p.id, p.category AS category_single, round(p.confidence, 6) AS confidence_single,
             v.ensemble_category AS category_ensemble, round(v.ensemble_confidence, 6) AS confidence_ensemble, v.ensemble_votes AS votes
           FROM predictions p JOIN voted v USING (id) WHERE p.model = 'full'""",
    ),
)
def _(spark, sf):
    done = voted(spark, sf)
    ensembled = _out(done).select(
        "id", F.col("ensemble_category").alias("category"), F.col("ensemble_confidence").alias("confidence"), F.col("ensemble_votes").alias("votes")
    )
    single = _single(done).withColumn("confidence", F.round("confidence", ROUND))
    return compare_results(single, ensembled, "id")


# ------------------------------------------------------------------- reports


@query(
    "f9_quality_filter",
    with_sql(VOTED_SQL, f"SELECT {_OUT} FROM voted WHERE ensemble_confidence >= 0.4 AND ensemble_votes >= 3"),
)
def _(spark, sf):
    return _out(filters.quality_filter(voted(spark, sf), min_confidence=0.4, min_votes=3))


@query(
    "f9_quality_report",
    with_sql(
        VOTED_SQL,
        """SELECT count(*) AS total, count(*) FILTER (ensemble_confidence >= 0.4) AS after_confidence,
             count(*) - count(*) FILTER (ensemble_confidence >= 0.4) AS removed_by_confidence,
             count(*) FILTER (ensemble_confidence >= 0.4 AND ensemble_votes >= 3) AS after_votes,
             count(*) FILTER (ensemble_confidence >= 0.4) - count(*) FILTER (ensemble_confidence >= 0.4 AND ensemble_votes >= 3) AS removed_by_votes,
             round(100.0 * count(*) FILTER (ensemble_confidence >= 0.4 AND ensemble_votes >= 3) / count(*), 4) AS kept_percent FROM voted""",
    ),
)
def _(spark, sf):
    return filters.quality_report(voted(spark, sf), min_confidence=0.4, min_votes=3)


@query("f10_low_confidence", with_sql(LABELS_SQL, "SELECT id, category, round(confidence, 6) AS confidence FROM labelled WHERE confidence < 0.5"))
def _(spark, sf):
    return filters.low_confidence(labelled(spark, sf)).select("id", "category", F.round("confidence", ROUND).alias("confidence"))


@query("f10_low_confidence_cut", with_sql(LABELS_SQL, "SELECT id, category, round(confidence, 6) AS confidence FROM labelled WHERE confidence < 0.2"))
def _(spark, sf):
    """A cut inside the data, which keeps some of the rows."""
    kept = filters.low_confidence(labelled(spark, sf), below=0.2)
    return kept.select("id", "category", F.round("confidence", ROUND).alias("confidence"))


@query(
    "a1_category_distribution",
    with_sql(
        VOTED_SQL,
        """SELECT ensemble_category AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM voted), 4) AS percent
           FROM voted WHERE ensemble_category IS NOT NULL GROUP BY ensemble_category""",
    ),
)
def _(spark, sf):
    return reports.category_distribution(voted(spark, sf), "ensemble_category")


@query(
    "a1_labels_with_nulls",
    with_sql(
        VECTORS_SQL,
        """SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM vectors), 4) AS percent
           FROM vectors WHERE category IS NOT NULL GROUP BY category""",
    ),
)
def _(spark, sf):
    return reports.category_distribution(vectors(spark, sf), "category")


@query("a2_mean_confidence", with_sql(LABELS_SQL, "SELECT round(avg(confidence), 6) AS mean_confidence FROM labelled"))
def _(spark, sf):
    return reports.mean_confidence(labelled(spark, sf))


@query(
    "a3_confidence_bands_cut",
    with_sql(
        LABELS_SQL,
        """SELECT band, count(l.id) AS n, round(100.0 * count(l.id) / (SELECT count(*) FROM labelled), 4) AS percent
           FROM (VALUES ('high'), ('medium'), ('low')) b(band)
           LEFT JOIN labelled l ON band = CASE WHEN confidence >= 0.27 THEN 'high' WHEN confidence >= 0.16 THEN 'medium' ELSE 'low' END GROUP BY band""",
    ),
)
def _(spark, sf):
    return reports.confidence_bands(labelled(spark, sf), high=0.27, medium=0.16)


@query(
    "a3_confidence_bands",
    with_sql(
        LABELS_SQL,
        """SELECT band, count(l.id) AS n, round(100.0 * count(l.id) / (SELECT count(*) FROM labelled), 4) AS percent
           FROM (VALUES ('high'), ('medium'), ('low')) b(band)
           LEFT JOIN labelled l ON band = CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END GROUP BY band""",
    ),
)
def _(spark, sf):
    return reports.confidence_bands(labelled(spark, sf))


@query(
    "a4_vote_histogram",
    with_sql(
        VOTED_SQL,
        "SELECT ensemble_votes AS votes, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM voted), 4) AS percent FROM voted GROUP BY ensemble_votes",
    ),
)
def _(spark, sf):
    return reports.vote_histogram(voted(spark, sf))


@query(
    "a9_documents_per_category",
    with_sql(
        VECTORS_SQL,
        """SELECT w.category, count(v.id) AS documents FROM (SELECT 'c' || c AS category FROM range(8) r(c) UNION ALL SELECT 'absent') w
           LEFT JOIN vectors v ON v.category = w.category GROUP BY w.category""",
    ),
)
def _(spark, sf):
    return reports.documents_per_category(vectors(spark, sf), "category", [*DOC_CATEGORIES, "absent"])
