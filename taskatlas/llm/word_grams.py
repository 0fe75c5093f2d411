"""Streams of word numbers, and the frequent words and word pairs of a whole corpus as a bit table of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14
TASK_BYTES = 1 << 28
U64 = np.uint64


class Vocabulary(dict):
    """Words (bytes) of one task, numbered as they come, with a 64-bit hash that is the same in every task."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self._hashes = np.empty(0, U64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def bound(self, size: int) -> None:
        """Start anew when there are more than ``size`` words."""
        if len(self) > size:
            self.clear()
            self.words, self._hashes = [], np.empty(0, U64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        """Hash of each word by its number."""
        new = self.words[len(self._hashes) :]
        if new:
            self._hashes = np.concatenate([self._hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), U64, len(new))])
        return self._hashes


def text_runs(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of ``text``; one long text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of all but its last part and the hash of that."""
    x = (left ^ (left >> U64(31))) * U64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class GramTable:
    """Says of the hash of a word or pair whether its bucket was seen often; never no for a frequent one."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def frequent(self, grams: np.ndarray) -> np.ndarray:
        bucket = grams >> U64(64 - self.bits)
        return (self.packed[bucket >> U64(3)] >> (bucket & U64(7)).astype(np.uint8)) & 1 == 1


def long_tasks(rows: DataFrame, size: int) -> DataFrame:
    """The rows in tasks that each read more of a corpus with ``size`` bytes of text: two for each core, or one for 256 MB.

    What a task counts, it hands over once for all it has read. In as many tasks as there are splits, every one would
    hand over nearly all frequent sequences, and their number grows with the corpus as that of the splits does.
    """
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def table_bits(size: int, least: int = 16, most: int = 27) -> int:
    """log2 of the buckets for a corpus of ``size`` bytes: one for about 32 bytes, at most 2 ** ``most``."""
    return min(most, max(least, (size // 32).bit_length()))


def _raise(counts: np.ndarray, at: np.ndarray, by: np.ndarray, top: int) -> None:
    counts[at] = np.minimum(counts[at].astype(np.int64) + by, top).astype(counts.dtype)


def frequent_grams(rows: DataFrame, grams_of: Callable[[], Callable[[pa.RecordBatch], Iterator[np.ndarray]]], min_count: int, bits: int) -> GramTable:
    """Buckets of hashes that hold ``min_count`` occurrences or more in all rows.

    ``grams_of`` runs once per task and returns a function from a batch to arrays of
    64-bit hashes. Every task has 2 ** ``bits`` counters that stop at ``min_count``;
    they are sent packed, in pieces, and each piece is added up as its copies stream by, so
    a task holds counters of fixed size whatever the corpus. The table that comes
    to the driver has 2 ** ``bits`` bits. Hashes that share a bucket only make a yes too many.
    """
    kind = np.uint8 if min_count < 256 else np.uint32
    size = min(CHUNK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, read = np.zeros(1 << bits, kind), grams_of()
        for batch in batches:
            for grams in read(batch):
                bucket, n = np.unique(grams >> U64(64 - bits), return_counts=True)
                _raise(counts, bucket, n, min_count)
        for chunk, part in enumerate(counts.reshape(-1, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch["chunk"].to_pylist(), batch["counts"]):
                part = np.frombuffer(zlib.decompress(packed.as_py()), kind)
                held = sums.setdefault(chunk, np.zeros(size, kind))
                held[:] = np.minimum(held.astype(np.int64) + part, min_count)
        for chunk, held in sums.items():
            bit = np.packbits(held >= min_count, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bit.tobytes()], pa.binary())], names=["chunk", "bits"])

    parts = rows.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, bits binary").toArrow()
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for chunk, found in zip(parts["chunk"].to_pylist(), parts["bits"].to_pylist()):
        packed[chunk * size // 8 : (chunk + 1) * size // 8] = np.frombuffer(found, np.uint8)
    return GramTable(packed, bits)


def merged_rows(columns: list[np.ndarray], counts: np.ndarray, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows that are equal in all columns as one with the sum of their counts.

    They are brought together by their hashes ``keys``; rows of one hash that differ
    stay apart, equal ones may stay apart beside them.
    """
    order = np.argsort(keys, kind="stable")
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.nonzero(new)[0]
    return [c[first] for c in columns], np.add.reduceat(counts, first) if len(first) else counts
