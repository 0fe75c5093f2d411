"""Token pieces of documents and their best-fit packing into sequences."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.sources.storage import stored

# Fixed value: how the byte-level vocabulary splits a text before it merges bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 0  # id after each document
GROUP_PIECES = 16_384  # pieces that are packed together


def byte_letters() -> dict[str, int]:
    """The vocabulary file writes bytes as letters: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to ids under a byte-level vocabulary file; its added tokens stand for themselves.

    Ids of such a vocabulary are in the order of its merges, so they serve as ranks.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def piece_bounds(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole ones, after a first one with what is over."""
    first = length % most or min(length, most)
    starts = [0, *range(first, length, most)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length], strict=True)]


def token_pieces(documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", most: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of whole texts, each followed by one end id.

    A null text counts as empty, so it is one piece of one id. Repeated rows repeat.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(vocabulary)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                owner, piece, start, length, check = [], [], [], [], []
                for row, text in enumerate(batch["text"]):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                    for p, (a, n) in enumerate(piece_bounds(len(ids), most)):
                        owner.append(row)
                        piece.append(p)
                        start.append(a)
                        length.append(n)
                        check.append(crc32(ids[a : a + n].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: largest first, into the open bin that suits it best.

    A piece needs (tokens, one document, tokens squared) and a bin has to have room
    for all three. ``norm`` takes the bin with the smallest weighted residual
    afterwards, ``dot`` the one whose residual points most along the needs.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room = np.empty((3, max(len(lengths), 1)))  # residual of the open bins, as shares of the capacity
    names = np.empty(max(len(lengths), 1), dtype=np.int64)
    used = np.zeros(max(len(lengths), 1), dtype=np.int64)
    open_bins = total = 0
    smallest = lengths.min(initial=0) / capacity[0]
    needs = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2]) / capacity[:, None]
    eps = 1e-12
    for i in order:
        need = needs[:, i]
        left = room[:, :open_bins]
        fits = np.flatnonzero((left[0] >= need[0] - eps) & (left[1] >= need[1] - eps) & (left[2] >= need[2] - eps))
        if len(fits):
            after = left[:, fits]
            value = (weights[:, None] * (after - need[:, None]) ** 2).sum(0) if rule == "norm" else -(weights * need) @ after
            at = fits[value.argmin()]
        else:
            at = open_bins
            room[:, at], names[at], used[at] = 1.0, total, 0
            open_bins, total = open_bins + 1, total + 1
        bins[i], offsets[i] = names[at], used[at]
        used[at] += lengths[i]
        room[:, at] -= need
        if room[0, at] < smallest - eps or room[1, at] < 1 / capacity[1] - eps:
            open_bins -= 1  # full: the last open bin takes its place
            room[:, at], names[at], used[at] = room[:, open_bins], names[open_bins], used[open_bins]
    return bins, offsets


def pack_documents(
    documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, max_documents: int = 2048,
    max_attention: float | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01), group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``.

    A sequence holds at most ``max_tokens`` ids, ``max_documents`` pieces and
    ``max_attention`` summed squared lengths (``max_tokens`` squared unless given).
    Pieces are dealt evenly to groups of about ``group_pieces``, whatever their ids,
    and a group packs by vector best-fit, so a group leaves at most about one bin
    open. Only lengths move; texts are read once. An empty table gives no rows;
    other columns are ignored. Stores the pieces while the plan is built.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    limit = float(max_tokens**2 if max_attention is None else max_attention)
    if limit < max_tokens**2:
        max_tokens = int(math.isqrt(int(limit)))  # a piece alone has to fit
    pieces = stored(token_pieces(documents, vocabulary, id_col=id_col, text_col=text_col, most=max_tokens), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    capacity, factors = np.array([max_tokens, max_documents, limit], dtype=float), np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            # The same pieces in any order of arrival are packed the same way.
            table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending")])
            bins, offsets = best_fit(table["length"].to_numpy(), capacity, factors, rule)
            first = TaskContext.get().partitionId() << 32
            table = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
            yield from table.combine_chunks().to_batches()

    columns = f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.repartition(groups).mapInArrow(run, columns)
