"""Nearest-category labels and their validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.text import MISSING
from taskatlas.functions.vectors import NORM_FLOOR, SCORE_DIGITS
from taskatlas.operators.embedding import evaluated_once
from taskatlas.operators.similarity import matrix_of

MAX_CATEGORIES = 4096

# Category names and descriptions, in the order that decides ties.
CATEGORIES: tuple[tuple[str, str], ...] = (
    ("computer vision", "methods to understand images and videos, including object detection, image recognition, facial recognition, and visual processing"),
    ("evolutionary computation", "methods mimicking evolution to solve problems using genetic algorithms, evolutionary strategies, and nature-inspired optimization"),
    ("AI hardware", "physical hardware designed specifically to implement AI software, including neural network processors, AI accelerators, and specialized chips"),
    ("knowledge processing", "methods to represent and derive new facts from knowledge bases, including ontologies, reasoning systems, and expert systems"),
    ("machine learning", "algorithms that learn from data, including supervised learning, unsupervised learning, reinforcement learning, and statistical models"),
    ("NLP", "methods to understand and generate human language, including text processing, sentiment analysis, machine translation, and language models"),
    ("planning and control", "methods to determine and execute plans to achieve goals, including robotics control, automated planning, and decision systems"),
    ("speech recognition", "methods to understand speech and generate responses, including voice recognition, speech-to-text, and audio processing"),
)

# The short descriptions used in prompts.
PROMPT_CATEGORIES: tuple[tuple[str, str], ...] = (
    ("computer vision", "methods to understand images and videos"),
    ("evolutionary computation", "methods mimicking evolution to solve problems"),
    ("AI hardware", "physical hardware designed specifically to implement AI software"),
    ("knowledge processing", "methods to represent and derive new facts from knowledge bases"),
    ("machine learning", "algorithms that learn from data"),
    ("NLP", "methods to understand and generate human language"),
    ("planning and control", "methods to determine and execute plans to achieve goals"),
    ("speech recognition", "methods to understand speech and generate responses"),
)


@dataclass(frozen=True)
class CategoryVectors:
    """Category names in tie order and one vector row each."""

    names: tuple[str, ...]
    matrix: np.ndarray

    def part(self, lo: int, hi: int) -> CategoryVectors:
        """The same categories over the dimensions ``lo`` to ``hi``, as unit vectors."""
        cut = self.matrix[:, lo:hi]
        return CategoryVectors(self.names, cut / np.maximum(np.linalg.norm(cut, axis=1, keepdims=True), NORM_FLOOR))


def category_vectors(categories: DataFrame, *, limit: int = MAX_CATEGORIES) -> CategoryVectors:
    """Read ``(cat_pos, category, vec)``; the row count is checked before it is used in tasks."""
    rows = categories.select("cat_pos", "category", "vec").orderBy("cat_pos").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories: match them as documents instead")
    return CategoryVectors(tuple(r["category"] for r in rows), np.array([r["vec"] for r in rows], dtype=np.float64))


def category_table(spark, categories: Sequence[tuple[str, str]] = CATEGORIES) -> DataFrame:
    """Ordered category definitions as a DataFrame."""
    rows = [(i, name, text) for i, (name, text) in enumerate(categories)]
    return spark.createDataFrame(rows, "cat_pos int, category string, description string")


def _best(matrix: np.ndarray, categories: CategoryVectors) -> tuple[np.ndarray, np.ndarray]:
    sims = np.round(matrix @ categories.matrix.T, SCORE_DIGITS)
    best = sims.argmax(axis=1)  # the first category on equal scores
    return best, sims[np.arange(len(best)), best]


def nearest_category(vec: Column, categories: CategoryVectors) -> Column:
    """Struct ``(category, confidence)`` of the category with the largest dot product."""
    names = pa.array(categories.names)

    @F.arrow_udf("struct<category string, confidence double>")
    def run(column: pa.Array) -> pa.Array:
        present = np.asarray(column.is_valid())
        best, sims = _best(matrix_of(column.drop_null()), categories) if present.any() else (np.zeros(0, int), np.zeros(0))
        at = np.zeros(len(column), dtype=np.int64)
        score = np.zeros(len(column))
        at[present], score[present] = best, sims
        label = names.take(pa.array(at, mask=~present))
        return pa.StructArray.from_arrays([label, pa.array(score, mask=~present)], ["category", "confidence"])

    return evaluated_once(run)(vec)


def classify(docs: DataFrame, categories: CategoryVectors, *, vec_col: str = "vec", blank: Column | None = None) -> DataFrame:
    """Add ``category`` and ``confidence``; blank text gives ``missing_data`` and 0."""
    found = nearest_category(F.col(vec_col), categories)
    out = docs.withColumn("__best", found)
    label, score = F.col("__best.category"), F.col("__best.confidence")
    if blank is not None:
        label = F.when(blank, F.lit(MISSING)).otherwise(label)
        score = F.when(blank, F.lit(0.0)).otherwise(score)
    return out.withColumns({"category": label, "confidence": score}).drop("__best")


def category_scores(docs: DataFrame, categories: CategoryVectors, *, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Similarity of every document with every category: ``(id, category, sim)``, cosine."""
    names = list(categories.names)
    unit = categories.part(0, categories.matrix.shape[1]).matrix

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        matrix = matrix_of(column)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), NORM_FLOOR)
        sims = np.round(matrix @ unit.T, SCORE_DIGITS)
        return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * sims.shape[1], sims.ravel())

    scored = docs.filter(F.col(vec_col).isNotNull()).select(id_col, run(F.col(vec_col)).alias("sims"))
    listed = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("category"), F.col("sims").alias("sim"))
    return scored.select(id_col, F.inline(listed).alias("category", "sim"))


def classify_models(
    docs: DataFrame, models: Sequence[tuple[str, int, int]], categories: CategoryVectors, *, vec_col: str = "vec"
) -> DataFrame:
    """Labels of several models in one pass: adds the array ``predictions``.

    A model is ``(name, lo, hi)``, a range of the vector's dimensions. Predictions
    of one document stay in one row, so a vote over them needs no shuffle.
    """
    parts = [(name, lo, hi, categories.part(lo, hi)) for name, lo, hi in models]
    names = pa.array(categories.names)
    entry = "struct<model_pos int, model string, category string, confidence double>"

    @F.arrow_udf(f"array<{entry}>")
    def run(column: pa.Array) -> pa.Array:
        matrix = matrix_of(column)
        rows, count = len(column), len(parts)
        at = np.zeros((rows, count), dtype=np.int64)
        score = np.zeros((rows, count))
        for i, (_, lo, hi, own) in enumerate(parts):
            cut = matrix[:, lo:hi]
            cut = cut / np.maximum(np.linalg.norm(cut, axis=1, keepdims=True), NORM_FLOOR)
            at[:, i], score[:, i] = _best(cut, own)
        flat = pa.StructArray.from_arrays(
            [
                pa.array(np.tile(np.arange(count, dtype=np.int32), rows)),
                pa.array([p[0] for p in parts]).take(pa.array(np.tile(np.arange(count), rows))),
                names.take(pa.array(at.ravel())),
                pa.array(score.ravel()),
            ],
            ["model_pos", "model", "category", "confidence"],
        )
        return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * count, flat)

    return docs.filter(F.col(vec_col).isNotNull()).withColumn("predictions", evaluated_once(run)(F.col(vec_col)))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def validation(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and support per category and the overall accuracy.

    Everything after the confusion counts works on at most categories² rows.
    """
    cells = confusion(df.filter(F.col(truth).isNotNull()), truth, predicted)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("category"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed")),
                F.struct(F.col("predicted").alias("category"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed")),
            )
        ),
        F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("hits"),
    )
    per = sides.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.sum("actual").alias("support"), F.sum("guessed").alias("guessed"), F.sum(F.col("hits") / 2).alias("hits")
    )
    total = cells.agg(
        (F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))) / F.sum("n")).alias("a")
    ).scalar()
    return per.select(
        "category",
        "support",
        F.round(F.try_divide(F.col("hits"), F.col("guessed")), 6).alias("precision"),
        F.round(F.try_divide(F.col("hits"), F.col("support")), 6).alias("recall"),
        F.round(total, 6).alias("accuracy"),
    )
