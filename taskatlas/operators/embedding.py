"""Text to vectors, token pooling, width, metadata and PCA."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.text import is_blank
from taskatlas.functions.vectors import NORM_FLOOR

# Divisor floor of mean pooling and the fill of masked positions in max pooling.
MASK_FLOOR = 1e-9
MASKED_VALUE = -1e9
# Text that an encoder takes at a time; a longer text stands alone.
SLICE_BYTES = 2 << 20


def token_bucket(token: str, width: int) -> int:
    """Bucket of a token: the first 32 bits of its md5, modulo the width."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % width


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in slices of about ``SLICE_BYTES``, so that a batch of long texts is not worked on at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield texts.slice(low, high - low)
        low = high


def evaluated_once(udf):
    """Keep the optimiser from copying a costly function into each use of its result.

    A filter on the result then stays above it: filters on other columns belong
    before the call.
    """
    return udf.asNondeterministic()


def encode_text(df: DataFrame, text_col: str, out: str = "vec", *, width: int = 64) -> DataFrame:
    """Hashed bag of words as a unit vector; blank text gives a zero vector.

    Words are lower-cased and split at white space. Row-local, so whole texts of
    any length are encoded without a shuffle and the same column works on a
    stream. Splitting, coding and counting run on Arrow batches; only the
    distinct words of a slice of some MB are hashed one by one.
    """

    def encoded(texts: pa.Array) -> pa.Array:
        rows = len(texts)
        # Trimmed first: the splitter may keep white space at the very end of its buffer.
        trimmed = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        words = pc.utf8_split_whitespace(trimmed)
        coded = words.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        # A blank text has one empty word; it counts in an extra column.
        buckets = np.array([token_bucket(w, width) if w else width for w in vocabulary], dtype=np.int64)
        cells = pc.list_parent_indices(words).to_numpy() * (width + 1)
        if len(cells):
            cells = cells + buckets[coded.indices.to_numpy()]
        counts = np.bincount(cells, minlength=rows * (width + 1)).reshape(rows, width + 1)[:, :width].astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(norms == 0, 1.0, norms)
        return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, unit.ravel())

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([encoded(part) for part in text_slices(texts)] or [encoded(texts)])

    return df.withColumn(out, evaluated_once(run)(F.col(text_col)))


def encode_with(
    df: DataFrame,
    text_col: str,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    out: str = "vec",
    *,
    width: int,
    batch_size: int = 32,
    max_words: int | None = None,
    unit: bool = True,
) -> DataFrame:
    """Encode with any model: ``make_encoder`` runs once per task and returns
    ``list[str] -> matrix``. Blank texts skip the model and get a zero vector.
    """

    def encoded(encoder: Callable[[list[str]], np.ndarray], texts: pa.Array) -> np.ndarray:
        values = [v or "" for v in texts.to_pylist()]
        if max_words is not None:
            values = [" ".join(v.split()[:max_words]) for v in values]
        filled = [i for i, v in enumerate(values) if v.strip()]
        matrix = np.zeros((len(values), width))
        for at in range(0, len(filled), batch_size):
            rows = filled[at : at + batch_size]
            matrix[rows] = encoder([values[i] for i in rows])
        if unit:
            matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), NORM_FLOOR)
        return matrix

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for texts in batches:
            matrix = np.concatenate([np.zeros((0, width)), *[encoded(encoder, part) for part in text_slices(texts)]])
            yield pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * width, matrix.ravel())

    return df.withColumn(out, evaluated_once(run)(F.col(text_col)))


def pool_tokens(token_rows: DataFrame, id_col: str = "doc_id", *, how: str = "mean") -> DataFrame:
    """Pool ``(id, pos, mask, vec)`` token rows to one vector per document.

    ``mean`` weighs by the mask, ``cls`` takes the first token, ``max`` ignores
    masked tokens. Vectors stay packed: the aggregate buffers one vector per
    document and combines before the shuffle.
    """
    if how == "cls":
        return token_rows.groupBy(id_col).agg(F.min_by("vec", "pos").alias("vec"))
    masked = F.col("mask") == 0
    if how == "mean":
        used = F.when(masked, F.transform("vec", lambda x: F.lit(0.0))).otherwise(
            F.transform("vec", lambda x: x * F.col("mask"))
        )
        pooled = token_rows.groupBy(id_col).agg(
            Summarizer.sum(array_to_vector(used)).alias("__sum"), F.sum("mask").cast("double").alias("__n")
        )
        by = F.greatest(F.col("__n"), F.lit(MASK_FLOOR))
        return pooled.select(id_col, F.transform(vector_to_array("__sum"), lambda x: x / by).alias("vec"))
    if how == "max":
        used = F.when(masked, F.transform("vec", lambda x: F.lit(MASKED_VALUE))).otherwise(F.col("vec"))
        pooled = token_rows.groupBy(id_col).agg(Summarizer.max(array_to_vector(used)).alias("__max"))
        return pooled.select(id_col, vector_to_array("__max").alias("vec"))
    raise ValueError(f"unknown pooling {how!r}")


def embedding_width(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    return df.agg(F.max(F.size(vec_col)).alias("width"))


def embedding_metadata(df: DataFrame, vec_col: str, text_col: str, id_col: str, *, samples: int = 5) -> DataFrame:
    """One row: vector count, width and the first texts by id.

    The sample is a top-k of its own, so no list of all texts is ever built.
    """
    shape = df.agg(F.count("*").alias("num_texts"), F.max(F.size(vec_col)).alias("embedding_dim"))
    first = df.select(id_col, text_col).orderBy(id_col).limit(samples)
    listed = F.sort_array(F.collect_list(F.struct(id_col, text_col)))
    texts = first.agg(F.transform(listed, lambda r: r[text_col]).alias("t"))
    return shape.select("*", texts.scalar().alias("sample_texts"))


def class_means(df: DataFrame, label_col: str, vec_col: str = "vec", *, unit: bool = True) -> DataFrame:
    """Mean vector per label, scaled to unit length; partial sums before the shuffle."""
    means = df.groupBy(label_col).agg(Summarizer.mean(array_to_vector(vec_col)).alias("__mean"))
    if unit:
        means = Normalizer(inputCol="__mean", outputCol="__out", p=2.0).transform(means)
        means = means.drop("__mean").withColumnRenamed("__out", "__mean")
    return means.select(label_col, vector_to_array("__mean").alias("vec"))


def reduce_dimensions(df: DataFrame, id_col: str, vec_col: str = "vec", *, n_components: int = 50) -> tuple[DataFrame, float]:
    """Project on the first principal components; also the explained variance share.

    Vectors are centred first (the library projects the values it is given).
    A component's sign is fixed so that its largest loading is positive.
    """
    vectors = df.select(id_col, array_to_vector(vec_col).alias("__v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(vectors).transform(vectors)
    model = PCA(k=n_components, inputCol="__c", outputCol="__p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(n_components)])
    flip = F.array(*[F.lit(float(s)) for s in signs])
    projected = model.transform(centred).select(
        id_col, F.zip_with(vector_to_array("__p"), flip, lambda x, s: x * s).alias("vec")
    )
    return projected, float(model.explainedVariance.toArray().sum())


def blank_to_zero(df: DataFrame, text_col: str, vec_col: str, width: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), width)
    return df.withColumn(vec_col, F.when(is_blank(F.col(text_col)), zero).otherwise(F.col(vec_col)))
