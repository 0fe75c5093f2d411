"""Whole runs over documents and task ratings.

Documents have ``application_id, application_title, application_abstract, year``;
ratings have the columns of ``operators.columns.RESULT_COLUMNS``. An encoder is a
function that adds a vector column ``vec`` for a text column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.text import combine_text, is_blank
from taskatlas.operators.classify import CategoryVectors, classify
from taskatlas.operators.embedding import encode_text
from taskatlas.operators.ensemble import combine_models, vote_long, with_base
from taskatlas.operators.exposure import exposure, task_matches
from taskatlas.operators.filters import filter_documents, from_year, quality_filter, valid_category
from taskatlas.operators.joins import remaining, spread_join
from taskatlas.operators.similarity import Plan, match_counts, neighbour_lists, top_k

Encoder = Callable[[DataFrame, str], DataFrame]
WIDTH = 64
hashed_words: Encoder = partial(encode_text, width=WIDTH)


def task_vectors(ratings: DataFrame, encode: Encoder) -> DataFrame:
    """Distinct task texts, each encoded once, as the query side of a match."""
    return encode(ratings.select("task").distinct(), "task").select(F.col("task").alias("qid"), "vec")


def document_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("combined", combine_text(F.col("application_title"), F.col("application_abstract")))


def label_run(
    docs: DataFrame,
    categories: CategoryVectors,
    *,
    encode: Encoder = hashed_words,
    start_year: int | None = None,
    years: Sequence[int] | None = None,
    done: DataFrame | None = None,
    keep_vectors: bool = False,
) -> DataFrame:
    """Label documents; those in ``done`` (id, category, confidence) keep their label.

    Documents outside ``years`` or before ``start_year`` are left out before anything
    is encoded. Of repeated ids in ``done`` the most confident row counts.
    Without ``done`` everything is row-local, so the run also works on a stream.
    ``keep_vectors`` leaves the column ``vec`` for a following match.
    """
    if keep_vectors and done is not None:
        raise ValueError("labels made earlier have no vectors")
    if start_year is not None:
        docs = from_year(docs, start_year)
    if years is not None:
        docs = docs.filter(F.col("year").isin(*years))
    todo = docs
    if done is not None:
        best = F.max_by(F.struct("category", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1.0)), "category"))
        done = done.filter(F.col("category").isNotNull()).groupBy("application_id").agg(best.alias("d")).select("application_id", "d.*")
        todo = remaining(docs, done, "application_id")
    labelled = classify(encode(document_text(todo), "combined"), categories, blank=is_blank(F.col("combined")))
    labelled = labelled.drop("combined") if keep_vectors else labelled.drop("combined", "vec")
    if done is None:
        return labelled
    kept = docs.join(done.select("application_id", "category", "confidence"), "application_id")
    return labelled.unionByName(kept)


def ensemble_run(
    inputs: Sequence[DataFrame],
    names: Sequence[str] | None = None,
    *,
    id_col: str = "application_id",
    weighted: bool = False,
    min_confidence: float | None = None,
    min_votes: int | None = None,
    base_columns: bool = False,
    **columns,
) -> DataFrame:
    """Vote over several label tables and keep the rows of the wanted quality.

    With ``base_columns`` the first input's other columns stand beside the vote.
    """
    voted = vote_long(combine_models(inputs, names, id_col, **columns), weighted=weighted)
    kept = quality_filter(voted, min_confidence=min_confidence, min_votes=min_votes)
    return with_base(kept, inputs[0], id_col) if base_columns else kept


def neighbours_by_year(
    docs: DataFrame,
    ratings: DataFrame,
    *,
    k: int = 100,
    encode: Encoder = hashed_words,
    years: Sequence[int] | None = None,
    category_col: str | None = None,
    topics: DataFrame | None = None,
    plan: Plan = Plan(),
) -> DataFrame:
    """Rating rows with the ``k`` documents nearest to their task in each year, by title."""
    kept = filter_documents(docs, category_col=category_col, topics=topics)
    if years is not None:
        kept = kept.filter(F.col("year").isin(*years))
    side = encode(kept, "application_title").select(F.col("application_id").alias("id"), "vec", "year")
    ranked = top_k(task_vectors(ratings, encode), side, k=k, keys=["year"], plan=plan)
    return ranked.withColumnRenamed("qid", "task")


def attach_neighbours(ratings: DataFrame, ranked: DataFrame, years: Sequence[int]) -> DataFrame:
    """One list column of neighbours per year beside every rating row."""
    lists = neighbour_lists(ranked.withColumnRenamed("task", "qid"), ["year"])
    wide = lists.groupBy(F.col("qid").alias("task")).pivot("year", list(years)).agg(F.first("neighbours"))
    named = wide.select("task", *[F.col(str(y)).alias(f"neighbours_{y}") for y in years])
    return spread_join(ratings, named, ["task"], "left")


def match_run(
    labelled: DataFrame,
    ratings: DataFrame,
    categories: Sequence[str],
    years: Sequence[int],
    *,
    threshold: float = 0.75,
    k: int | None = 500,
    encode: Encoder = hashed_words,
    plan: Plan = Plan(),
) -> DataFrame:
    """Match counts of every rating row per category and year, zeros included.

    Documents are encoded unless they carry the column ``vec``.
    """
    kept = labelled.filter(valid_category(F.col("category")) & F.col("category").isin(*categories) & F.col("year").isin(*years))
    encoded = kept if "vec" in kept.columns else encode(document_text(kept), "combined")
    side = encoded.select(F.col("application_id").alias("id"), "vec", "category", "year")
    counts = match_counts(task_vectors(ratings, encode), side, threshold=threshold, k=k, plan=plan)
    return task_matches(ratings, counts.withColumnRenamed("qid", "task"), categories, years)


def exposure_run(labelled: DataFrame, ratings: DataFrame, categories: Sequence[str], years: Sequence[int], **matching) -> DataFrame:
    """From labelled documents to exposure per occupation, category and year."""
    return exposure(match_run(labelled, ratings, categories, years, **matching))
