"""Toxicity by the nearest labelled examples under the exact cosine of contrast-weighted TF-IDF, found with block maxima."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.llm.batches import BATCH_ROWS, score_texts
from taskatlas.llm.samples import fold, labelled_texts
from taskatlas.llm.words import byte_words

BLOCK = 16  # examples that share one maximum per term
COMMON = 8  # a term in one of so many examples has full rows instead of postings
SLACK = 1e-8
TOGETHER = 128  # vectors searched at a time
FIRST = 16  # blocks scored before the limit is taken again
HELD_WORDS = 300_000
BEGINNINGS = (4, 5)  # bytes of a word's beginnings that are terms beside the word
NONE = np.empty(0, np.int64)


def terms_of(text: str | None) -> list[bytes]:
    """Words of a whole text and the beginnings of longer words, which inflected forms and compounds share."""
    tokens = byte_words(text)
    return tokens + [w[:n] + b" " for n in BEGINNINGS for w in tokens if len(w) > n]


class TermNumbers(dict):
    """Where the numbers of a word's terms stand; words of one task are remembered, up to ``HELD_WORDS``."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary, self.numbers = vocabulary, array("i")

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        number = self.vocabulary.get
        self.numbers.append(number(word, -1))
        for n in BEGINNINGS:
            self.numbers.append(number(word[:n] + b" ", -1) if len(word) > n else -1)
        return row

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers and counts of the known terms of a whole text."""
        if len(self) > HELD_WORDS:
            self.clear()
            self.numbers = array("i")
        words = Counter(byte_words(text))
        if not words:
            return NONE, NONE
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found = np.frombuffer(self.numbers, np.int32).reshape(-1, 1 + len(BEGINNINGS))[rows].ravel()
        order = np.argsort(found, kind="stable")
        order = order[np.searchsorted(found[order], 0) :]
        if not len(order):
            return NONE, NONE
        ids, counts = found[order], np.fromiter(words.values(), np.int64, len(words))[order // (1 + len(BEGINNINGS))]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return ids[first].astype(np.int64), np.add.reduceat(counts, first)


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``first[i] .. first[i] + sizes[i] - 1`` of all ``i``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


Vector = tuple[np.ndarray, np.ndarray]  # sorted term numbers and weights


class BlockMaxIndex:
    """Unit example vectors by term and block of examples, with the largest weight of each block.

    A rare term's postings are added outright: a list of its block maxima would be as
    long. Terms in one of ``COMMON`` examples or more have rows of weights and of block
    maxima. Rare part and maxima bound the cosines of a block, so blocks are scored best
    bound first until no bound reaches the k-th cosine.
    """

    def __init__(self, rows: list[Vector], terms: int, block: int = BLOCK):
        self.n, self.size, self.blocks = len(rows), block, max(1, -(-len(rows) // block))
        # Examples with the same heaviest term stand together, which keeps a block's maxima near its weights.
        heaviest = np.array([r[0][np.argmax(r[1])] if len(r[0]) else -1 for r in rows], dtype=np.int64)
        self.example = np.argsort(heaviest, kind="stable")
        rows = [rows[i] for i in self.example]
        term = np.concatenate([r[0] for r in rows] or [NONE]).astype(np.int64)
        place = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]).astype(np.int64)
        weight = np.concatenate([r[1] for r in rows] or [np.empty(0)]).astype(np.float64)
        common = np.flatnonzero(np.bincount(term, minlength=terms) * COMMON >= max(self.n, 1))
        self.row = np.full(terms, -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), self.blocks * block))
        at = self.row[term]
        self.full[at[at >= 0], place[at >= 0]] = weight[at >= 0]
        self.full_top = self.full.reshape(len(common), self.blocks, block).max(axis=2)

        term, place, weight = term[at < 0], place[at < 0], weight[at < 0]
        order = np.lexsort((place, term))
        self.place, self.weight = place[order].astype(np.int32), weight[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1)).astype(np.int32)  # where the postings of each term begin

    def nearest(self, vectors: list[Vector], k: int, without: np.ndarray | None = None) -> tuple[list[Vector], np.ndarray]:
        """For each of a few vectors the ``k`` examples with the largest positive cosine, ties to the earlier one,
        and the number of blocks scored; exact. ``without`` names one example per vector to leave out.

        Cosines are rounded to nine digits, so ties do not depend on the order of addition.
        """
        found, scored = [], []
        for at in range(0, len(vectors), TOGETHER):
            scores, blocks = self._scores(vectors[at : at + TOGETHER], k, None if without is None else without[at : at + TOGETHER])
            found += [self._largest(s, k) for s in np.round(scores, 9, out=scores)[:, : self.n]]
            scored.append(blocks)
        return found, np.concatenate(scored or [NONE])

    def _scores(self, vectors: list[Vector], k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines by place, exact where they reach the k-th and below it elsewhere; blocks scored by vector."""
        shape = len(vectors), self.blocks
        common, scores = np.zeros((len(vectors), len(self.full))), np.empty((len(vectors), self.blocks * self.size))
        for i, (ids, weights) in enumerate(vectors):
            at = self.row[ids]
            common[i, at[at >= 0]] = weights[at >= 0]
            first, weights = self.start[ids[at < 0]], weights[at < 0]
            sizes = self.start[ids[at < 0] + 1] - first
            postings = ranges(first, sizes)
            scores[i] = np.bincount(self.place[postings], np.repeat(weights, sizes) * self.weight[postings], minlength=scores.shape[1])
        bounds = scores.reshape(*shape, self.size).max(axis=2) + common @ self.full_top
        if without is not None:
            scores[np.arange(len(vectors)), np.argsort(self.example)[without]] = -np.inf
        rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
        scored = np.zeros(len(vectors), np.int64)
        for done, end in ((0, FIRST), (FIRST, self.blocks)):
            # A cosine is at least its rare part, so the k-th of what is known is a limit. SLACK covers rounding.
            least = np.partition(scores, -k, axis=1)[:, -k, None] if k < scores.shape[1] else np.zeros((len(vectors), 1))
            wanted = (rank >= done) & (rank < end) & (bounds > 0) & (bounds + SLACK >= least)
            scored += wanted.sum(axis=1)
            for b in np.flatnonzero(wanted.any(axis=0)):
                who, columns = np.flatnonzero(wanted[:, b]), slice(b * self.size, (b + 1) * self.size)
                scores[who, columns] += common[who] @ self.full[:, columns]
        return scores, scored

    def _largest(self, scores: np.ndarray, k: int) -> Vector:
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
        at = np.flatnonzero((scores >= least) & (scores > 0))
        near, best = self.example[at], scores[at]
        order = np.lexsort((near, -best))[:k]
        return near[order], best[order]


def unit_vector(ids: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and unit TF-IDF weights."""
    weights = (1.0 + np.log(counts)) * weight[ids]
    norm = np.sqrt(weights @ weights)
    return ids, weights / norm if norm > 0 else weights


def vote(labels: np.ndarray, near: np.ndarray, cosines: np.ndarray) -> float:
    """Share of label 1, each neighbour weighted by its squared cosine; NaN without neighbours."""
    strength = cosines * cosines
    return float((strength * labels[near]).sum() / strength.sum()) if len(near) else float("nan")


def calibration(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Slope and offset of a logistic curve over the votes, fitted with Newton steps, and
    the rate without neighbours; classes are weighted to ``prior``."""
    weight = np.where(labels == 1, prior / max((labels == 1).mean(), 1e-9), (1 - prior) / max((labels == 0).mean(), 1e-9))
    alone = np.isnan(votes)
    none_rate = float(((labels * weight)[alone].sum() + prior) / (weight[alone].sum() + 1.0))
    x, y, w = votes[~alone], labels[~alone].astype(float), weight[~alone]
    a, b = 4.0, -2.0
    if len(x):
        design = np.stack([x, np.ones_like(x)], 1)
        for _ in range(30):
            p = 1.0 / (1.0 + np.exp(-np.clip(design @ [a, b], -30, 30)))
            grad = design.T @ (w * (p - y)) + 0.05 * np.array([a, b])
            hess = (design * (w * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
            a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return float(a), float(b), none_rate


def _example_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Ids and labels of the bounded sample, all its terms, and the sorted term numbers and
    counts of each example; texts are split where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms_of(t)) for t in batch["text"].to_pylist()]
            columns = [batch["doc_id"], batch["label"], pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "words", "counts"])

    rows = sample.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text")
    got = rows.mapInArrow(run, "doc_id long, label int, words array<binary>, counts array<long>").toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending")])
    coded = pc.list_flatten(got["words"]).combine_chunks().dictionary_encode()
    codes, counts = coded.indices.to_numpy().astype(np.int64), pc.list_flatten(got["counts"]).to_numpy()
    sizes = pc.list_value_length(got["words"]).to_numpy()
    order = np.lexsort((codes, np.repeat(np.arange(len(sizes)), sizes)))
    cuts = np.cumsum(sizes)[:-1]
    examples = list(zip(np.split(codes[order], cuts), np.split(counts[order], cuts), strict=True)) if len(sizes) else []
    return got["doc_id"].to_numpy(), got["label"].to_numpy(), coded.dictionary.to_pylist(), examples


def contrasts(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int) -> np.ndarray:
    """For each term, how many standard errors its shares of the examples of the two labels lie apart."""
    ones, zeros = max(int((labels == 1).sum()), 1), max(int((labels == 0).sum()), 1)
    a, b = (np.bincount(np.concatenate([e[0] for e, l in zip(examples, labels, strict=True) if l == label] or [np.empty(0, np.int64)]), minlength=terms) for label in (1, 0))
    share = (a + b) / (ones + zeros)
    return np.abs(a / ones - b / zeros) / np.maximum(np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros)), 1e-9)


def document_frequencies(documents: DataFrame, text_col: str, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Rows of the whole table and, for each term, the rows that hold it; a task sends one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen, numbers = 0, np.zeros(len(vocabulary) + 1, dtype=np.int64), TermNumbers(vocabulary)
        for batch in batches:
            for text in batch["text"].to_pylist():
                rows += 1
                seen[numbers.counted(text)[0]] += 1
        seen[-1] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["term", "n"])

    counted = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term int, n long")
    found = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    sums = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return int(found[-1]), found[:-1]


class ToxicityModel:
    """The index, its vocabulary and the calibrated curve; small and sent to every task."""

    def __init__(self, vocabulary, weight, index, ids, marks, slope, offset, none_rate, k):
        self.vocabulary, self.weight, self.index, self.ids, self.marks = vocabulary, weight, index, ids, marks
        self.slope, self.offset, self.none_rate, self.k = slope, offset, none_rate, k

    def judge(self, text: str | None) -> tuple[float, list[dict]]:
        """Score of a whole text and the examples that voted."""
        return self.judge_all([text], TermNumbers(self.vocabulary))[0]

    def judge_all(self, texts: list[str | None], numbers: TermNumbers) -> list[tuple[float, list[dict]]]:
        """The same for a batch of texts; ``numbers`` are those of the model's vocabulary."""
        if self.index is None:
            return [(self.none_rate, [])] * len(texts)
        found = []
        vectors = [unit_vector(*numbers.counted(text), self.weight) for text in texts]
        for near, cosines in self.index.nearest(vectors, self.k)[0]:
            share = vote(self.marks, near, cosines)
            score = self.none_rate if np.isnan(share) else float(1.0 / (1.0 + np.exp(-(self.slope * share + self.offset))))
            found.append((score, [{"doc_id": int(self.ids[i]), "cosine": float(c), "label": int(self.marks[i])} for i, c in zip(near, cosines, strict=True)]))
        return found


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", examples_per_label: int = 1_500,
    folds: int = 5, k: int = 15,
) -> ToxicityModel:
    """Index up to ``examples_per_label`` labelled texts of each label and fit the curve.

    Only ids whose crc32 is not divisible by ``folds`` are used. The index holds every term
    (word or beginning of a word) of these texts. Document frequencies are counted over all
    of ``documents``; a term weighs its inverse document frequency times one plus the
    standard errors between its shares of the two labels, which is never zero.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col("label").cast("int").alias("label")).filter("label IN (0, 1)")
    learn = usable.filter(fold(F.col("doc_id"), folds) != 0)
    prior = float(learn.agg(F.avg("label")).first()[0] or 0.0)
    sample = labelled_texts(documents, learn.select(F.col("doc_id").alias(id_col), "label"), examples_per_label, id_col=id_col, text_col=text_col)
    ids, marks, terms, examples = _example_counts(sample)
    if not terms or not 0 < marks.sum() < len(marks):
        return ToxicityModel({}, np.zeros(0), None, ids, marks, 0.0, 0.0, prior, k)
    vocabulary = {w: i for i, w in enumerate(terms)}
    rows, seen = document_frequencies(documents, text_col, vocabulary)
    weight = np.log((rows + 1.0) / (np.minimum(seen, rows) + 0.5)) * (1.0 + contrasts(examples, marks, len(terms)))
    vectors = [unit_vector(*e, weight) for e in examples]
    index = BlockMaxIndex(vectors, len(terms))
    own = [
        vote(marks, *found) for at in range(0, len(vectors), BATCH_ROWS)
        for found in index.nearest(vectors[at : at + BATCH_ROWS], k, np.arange(at, min(at + BATCH_ROWS, len(vectors))))[0]
    ]
    return ToxicityModel(vocabulary, weight, index, ids, marks, *calibration(np.array(own), marks, prior), k)


def score_toxicity(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **options) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted, evidence``.

    ``labels`` has ``doc_id, label`` (0 or 1); ``options`` are those of ``fit_toxicity``.
    Texts are compared by all terms; block maxima leave out examples that
    cannot be among the nearest. The nearest vote by squared cosine and the curve fitted to leave-one-out votes turns
    the vote into ``score``. ``evidence`` lists ``(doc_id, cosine, label)`` of the voters.

    A text that shares no term with any example, an empty or a null one has the
    calibrated rate of such examples and no evidence. Without examples of both labels
    every score is the share of label 1 (0 without labels). Repeated rows repeat,
    other columns are ignored, an empty table gives no rows. Runs jobs while the plan
    is built.
    """
    model = fit_toxicity(documents, labels, id_col=id_col, text_col=text_col, folds=folds, **options)

    def make():
        numbers = TermNumbers(model.vocabulary)
        return lambda texts: list(map(list, zip(*model.judge_all(texts, numbers), strict=True))) if texts else [[], []]

    scored = score_texts(documents, id_col, text_col, make, "score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(documents: DataFrame, labels: DataFrame, *, text_col: str = "text", reject_from: float = 0.5, **options) -> DataFrame:
    """The documents with all their columns whose score is below ``reject_from``; row-local."""
    model = fit_toxicity(documents, labels, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TermNumbers(model.vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                yield batch.filter(pa.array([score < reject_from for score, _ in model.judge_all(batch[text_col].to_pylist(), numbers)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
