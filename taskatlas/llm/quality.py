"""Graded quality: an ordinal regression on hashed words, shapes and repetition."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.llm.batches import score_texts
from taskatlas.llm.samples import fold, labelled_texts

BITS = 13
# Capitals, small letters and all else that is not ASCII, digits; other signs stay.
SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def hashed(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets of a whole text's tokens and of their shapes, of sizes and of repetition; none without tokens."""
    data = (text or "").encode("utf-8", "surrogatepass")
    tokens = data.split()
    n = len(tokens)
    if not n:
        return np.empty(0, dtype=np.int64)
    lines = data.splitlines()
    facts = (
        b"\x00size %d" % n.bit_length(),
        b"\x00distinct %d" % (10 * len(set(tokens)) // n),
        b"\x00lines %d" % (10 * len(set(lines)) // len(lines)),
        b"\x00length %d" % (len(data) // n),
    )
    count = max(1, n // 16)  # the facts weigh like some of the words
    ids = np.fromiter(map(crc32, tokens), np.int64, n)
    shapes = np.fromiter(map(crc32, data.translate(SHAPES).split()), np.int64, n)
    return np.concatenate([ids, shapes + 1, np.repeat(np.fromiter(map(crc32, facts), np.int64, len(facts)), count)]) & ((1 << bits) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class OrdinalModel:
    """Cumulative links: P(grade > k) = sigmoid(weights . x - threshold_k), thresholds in order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, utility: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each utility."""
        return sigmoid(utility[:, None] - self.thresholds[None, :])

    def utility(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].mean())


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, classes: int, bits: int = BITS, *, steps: int = 150, rate: float = 0.3, decay: float = 1e-5) -> OrdinalModel:
    """Adam on the whole sample; thresholds are a first one and positive gaps, so they stay in order."""
    cells, owners, values = [], [], []
    for i, buckets in enumerate(rows):
        ids, counts = np.unique(buckets, return_counts=True)
        cells.append(ids)
        owners.append(np.full(len(ids), i))
        values.append(counts / len(buckets))
    cell, owner, value = np.concatenate(cells), np.concatenate(owners), np.concatenate(values)
    n, size = len(rows), 1 << bits
    seen = np.bincount(grades, minlength=classes)
    above = np.clip(seen[::-1].cumsum()[::-1][1:] / n, 0.02, 0.98)
    start = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    params = np.concatenate([np.zeros(size), start[:1], gaps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    over = (grades[:, None] > np.arange(classes - 1)[None, :]).astype(float)
    for step in range(1, steps + 1):
        weights, thresholds = params[:size], params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))])
        utility = np.bincount(owner, weights[cell] * value, minlength=n)
        # Log-loss of each "above k" question; the shared weights answer all of them.
        error = (sigmoid(utility[:, None] - thresholds[None, :]) - over) / n
        by_weight = np.bincount(cell, error.sum(1)[owner] * value, minlength=size) + decay * weights
        by_threshold = -error.sum(0)
        tail_sums = by_threshold[::-1].cumsum()[::-1]
        grad = np.concatenate([by_weight, tail_sums[:1], tail_sums[1:] * np.exp(params[size + 1 :])])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(params[:size], params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))]))


def training_buckets(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and grades of the bounded sample; texts are hashed where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [hashed(t).astype(np.uint16).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch["label"]], names=["buckets", "label"])

    rows = sample.select("text", F.col("label").cast("int")).mapInArrow(run, "buckets binary, label int").filter(F.length("buckets") > 0)
    got = rows.toArrow()
    return [np.frombuffer(b, np.uint16).astype(np.int64) for b in got["buckets"].to_pylist()], got["label"].to_numpy().astype(np.int64)


def grade_documents(
    documents: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: int = 3,
    max_rows_per_grade: int = 2_000, folds: int = 5, keep_from: int = 1, keep_at: float = 0.5,
) -> DataFrame:
    """Per row: ``doc_id, held_out, expected_grade, tail, keep``.

    ``ratings`` has ``doc_id, label`` with grades 0 to ``classes`` - 1. The model is
    fitted on at most ``max_rows_per_grade`` texts of each grade whose id has a
    crc32 not divisible by ``folds``. ``tail`` is P(grade >= ``keep_from``), ``keep``
    says whether it reaches ``keep_at``.

    Null texts and texts without a token have grade 0 and tail 0. Without any
    usable rating, texts with tokens have the middle grade and tail 0.5. Repeated
    rows repeat, other columns are ignored, an empty table gives no rows. Fits while
    the plan is built.
    """
    learn = ratings.filter((fold(F.col(id_col), folds) != 0) & F.col("label").between(0, classes - 1))
    rows, grades = training_buckets(labelled_texts(documents, learn, max_rows_per_grade, id_col=id_col, text_col=text_col))
    if rows:
        model = fit_ordinal(rows, grades, classes)
    else:
        middle = np.sort(np.log(np.arange(1.0, classes) / np.arange(classes - 1.0, 0.0, -1.0)))
        model = OrdinalModel(np.zeros(1 << BITS), middle - middle[keep_from - 1])
    weights, thresholds = model.weights, model.thresholds

    def make():
        fitted = OrdinalModel(weights, thresholds)

        def run(texts: list[str | None]) -> list[list]:
            expected, tail = [], []
            for text in texts:
                buckets = hashed(text)
                tails = fitted.tails(np.array([fitted.utility(buckets)]))[0] if len(buckets) else np.zeros(classes - 1)
                expected.append(float(tails.sum()))
                tail.append(float(tails[keep_from - 1]))
            return [expected, tail]

        return run

    scored = score_texts(documents, id_col, text_col, make, "expected_grade double, tail double")
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "expected_grade", "tail", (F.col("tail") >= keep_at).alias("keep"))
