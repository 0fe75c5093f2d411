"""Exact top-k inner products over length-sorted ranges of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.operators.ranking import top_per_group
from taskatlas.sources.storage import stored

SLACK = 1e-9  # relative room for rounding in every bound
EXACT = 2.0**52  # doubles hold all integers up to here
FOCUS = 3  # coordinates looked at when pruning by coordinate


def quantized(vec: Column, steps: int = 64) -> Column:
    """``floor(steps * x)`` of each component as a double; null for a null vector or
    one that holds a null, NaN or infinite component."""
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vec.isNotNull() & usable, F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(steps))).cast("long")))


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer products, through doubles where these are exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if most < EXACT:
        return left.astype(np.float64) @ right.astype(np.float64).T
    return left @ right.T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, least: float, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores of at least ``least``, ties to smaller ids, without the own row."""
    at = np.flatnonzero((scores >= least) & (ids != own))
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def local_thresholds(least: np.ndarray, norms: np.ndarray, longest: float) -> np.ndarray:
    """Cosine that a vector no longer than ``longest`` needs to reach each query's bound."""
    room = norms * longest
    reach = np.where(room > 0, least / np.where(room > 0, room, 1.0), np.where(least > 0, np.inf, -np.inf))
    return np.where(np.isneginf(least), -np.inf, reach)


def coordinate_range(coordinate: float, cosine: float) -> tuple[float, float]:
    """Where a coordinate of a unit vector can lie when its cosine with a query whose
    coordinate is given is at least ``cosine``."""
    mine, room = math.acos(max(-1.0, min(1.0, coordinate))), math.acos(max(-1.0, min(1.0, cosine)))
    low = -1.0 if mine + room >= math.pi else math.cos(mine + room)
    high = 1.0 if mine <= room else math.cos(mine - room)
    return low - 1e-7, high + 1e-7


def search_range(
    queries: np.ndarray, query_ids: np.ndarray, query_norms: np.ndarray, least: np.ndarray,
    items: np.ndarray, item_ids: np.ndarray, item_norms: np.ndarray, k: int, coordinate_from: float,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query position, item positions, scores)`` inside one range of items.

    Per query, the local cosine threshold picks the pruning: above 1 the range
    holds nothing; from ``coordinate_from`` on, sorted coordinate lists leave the
    items that can reach it; below, the items long enough are taken. What is left
    is verified with whole products.
    """
    order = np.argsort(-item_norms, kind="stable")
    items, item_ids, item_norms = items[order], item_ids[order], item_norms[order]
    cosine = local_thresholds(least, query_norms, item_norms[0])
    by_coordinate = (cosine >= coordinate_from) & (cosine <= 1 + SLACK)
    by_length = cosine < coordinate_from
    unit = items / np.where(item_norms > 0, item_norms, 1.0)[:, None]
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in np.flatnonzero(by_coordinate):
        direction = queries[q] / query_norms[q]
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        alive = None
        for f in focus:
            low, high = coordinate_range(direction[f], cosine[q])
            if alive is None:
                if f not in lists:
                    by = np.argsort(unit[:, f], kind="stable")
                    lists[f] = (by, unit[by, f])
                by, values = lists[f]
                alive = by[np.searchsorted(values, low) : np.searchsorted(values, high, "right")]
            else:
                alive = alive[(unit[alive, f] >= low) & (unit[alive, f] <= high)]
        alive = np.sort(alive)
        scores = _products(queries[q : q + 1], items[alive])[0]
        hit = _best(scores, item_ids[alive], query_ids[q], least[q], k)
        yield q, order[alive[hit]], scores[hit]
    rows = np.flatnonzero(by_length)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        shortest = np.where((least[part] > 0) & (query_norms[part] > 0), least[part] / np.maximum(query_norms[part], 1e-300), 0.0)
        long_enough = np.searchsorted(-item_norms, -shortest * (1 - SLACK), "right")
        scores = _products(queries[part], items[: long_enough.max(initial=0)])
        for i, q in enumerate(part):
            hit = _best(scores[i, : long_enough[i]], item_ids[: long_enough[i]], query_ids[q], least[q], k)
            yield q, order[hit], scores[i, hit]


def top_products(
    vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, *, k: int = 20,
    range_rows: int = 32_768, lane_rows: int = 8_192, seed_rows: int = 4_096, coordinate_from: float = 0.8,
) -> DataFrame:
    """The ``k`` largest inner products of each query row with all other rows.

    ``vec_col`` holds long arrays; the result is ``query_id, rank, vec_id, score``
    and is exact, ties to smaller ids. Items are range-partitioned by length, so a
    range has rows of near-equal length and equal vectors are split by id. The
    longest ``seed_rows`` give each query a first lower bound. From it follows the
    last range that can hold a better item; queries are copied to the ranges up to
    that one and meet them in groups of at most ``range_rows`` x ``lane_rows``.

    Rows with a null id or vector take no part. Shorter vectors count as padded
    with zeros. Of rows that share an id the one with the smallest vector is kept.
    An empty table gives no rows; extra columns are ignored. Scores beyond 64 bits
    are not defined. Runs jobs while the plan is built: sizes, storing, seeds.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    rows = base.filter("id IS NOT NULL AND vec IS NOT NULL").groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    total, asking, width = stored_sizes(rows)
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cores = spark.sparkContext.defaultParallelism
    ranges = max(math.ceil(total / range_rows), min(cores, math.ceil(total / 2_048)))
    lanes = max(math.ceil(asking / lane_rows), 1)
    padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sized = rows.select("id", "asks", padded.alias("vec"), norm.alias("norm"))
    items = stored(
        sized.repartitionByRange(ranges, F.col("norm").desc(), F.col("id")).withColumn("part", F.spark_partition_id()), "products-items"
    )
    # One number for each range, that is total / range_rows of them; an empty range has no row.
    lengths = {r["part"]: r["longest"] for r in items.groupBy("part").agg(F.max("norm").alias("longest")).collect()}
    each = np.array([lengths.get(p, 0.0) for p in range(max(lengths) + 1)])
    # Longest length from each range on, so that all ranges after a cut can be left out.
    longest = np.maximum.accumulate(each[::-1])[::-1]
    seeds = items.orderBy(F.col("norm").desc(), "id").limit(seed_rows).select("id", "vec").toArrow()
    seed_ids, seed_matrix = seeds["id"].to_numpy(), _matrix(seeds["vec"], width)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, norms = batch["id"].to_numpy(), batch["norm"].to_numpy()
                scores = _products(_matrix(batch["vec"], width), seed_matrix)
                least = np.full(len(ids), -np.inf)
                for i, own in enumerate(ids):
                    best = _best(scores[i], seed_ids, own, -np.inf, k)
                    if len(best) == k:
                        least[i] = scores[i, best[-1]]
                need = np.where((least > 0) & (norms > 0), least / np.maximum(norms, 1e-300), 0.0) * (1 - SLACK)
                last = np.searchsorted(-longest, -need, "right")
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["norm"], batch["vec"], pa.array(least), pa.array(last.astype(np.int32))],
                    names=["id", "norm", "vec", "least", "last"],
                )

    bounded = items.filter("asks").select("id", "norm", "vec").mapInArrow(bound, "id long, norm double, vec array<long>, least double, last int")
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")
    visits = F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("part")
    asked = bounded.filter("last > 0").withColumn("lane", lane).select("id", "norm", "vec", "least", "lane", visits)
    offered = items.select("part", "id", "norm", "vec", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, asks = right["id"].to_numpy(), left["id"].to_numpy()
            for q, at, scores in search_range(
                _matrix(left["vec"], width), asks, left["norm"].to_numpy(), left["least"].to_numpy(),
                _matrix(right["vec"], width), ids, right["norm"].to_numpy(), k, coordinate_from,
            ):
                found.append(pa.table([pa.array(np.full(len(at), asks[q])), pa.array(ids[at]), pa.array(scores.astype(np.int64))], schema=out))
        return pa.concat_tables(found) if found else out.empty_table()

    pairs = asked.groupBy("part", "lane").cogroup(offered.groupBy("part", "lane")).applyInArrow(match, "query_id long, vec_id long, score long")
    best = top_per_group(pairs, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, rank="rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def stored_sizes(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, query rows and the longest vector."""
    r = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("vec")).alias("w")).first()
    return r["n"], r["q"], r["w"] or 0
