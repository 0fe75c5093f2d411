"""Similarity join of task vectors with document vectors.

Both sides are ``(id, vec)`` tables; documents may carry grouping columns (a
category, a year). Scores are exact; ``approximate_top_k`` leaves out documents.

Two physical ways with the same result, chosen by the measured size of the query
side:

* *resident*: the query matrix is below ``resident_bytes``. It is broadcast and
  documents stream past it where they lie; only counts or local top-k rows are
  shuffled.
* *grid*: any size. Documents are dealt to ranges and queries to lanes by a hash of
  their ids. A query is copied once to each range, a document once to each lane, and
  each (range, lane) pair is one group: its queries are held, its documents stream
  past them. Lanes are bounded by memory, ranges need no bound, so that there are at
  most ``COPIES`` of each until the query matrix passes COPIES x RESIDENT_BYTES. No key
  of the data decides where a row goes, so no group is hot.

Scores never leave a task as pairs: block products are reduced to hits, running
counts or a running top-k, whose state has a fixed limit. All operators that match
run small jobs while the plan is built (sizes; the grid also stores its inputs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from taskatlas.functions.vectors import MATCH_NORM_OFFSET, SCORE_DIGITS
from taskatlas.operators.ranking import top_per_group
from taskatlas.sources.storage import stored

RESIDENT_BYTES = 64 << 20
PRODUCT_CELLS = 4 << 20
STATE_CELLS = 16 << 20
OUT_ROWS = 50_000
# Places of a query in a running top-k, at least.
LEAST_ROOM = 32
RANGE_ROWS = 16_384
LANE_ROWS = 2_048
COPIES = 16
MAX_TASKS = 1_024
# A product this far below a bound can still be rounded up to it.
ROUNDING = 2 * 10.0**-SCORE_DIGITS


@dataclass(frozen=True)
class Plan:
    """Physical settings of a match; the defaults suit executors of a few GiB."""

    resident_bytes: int = RESIDENT_BYTES
    range_rows: int = RANGE_ROWS
    lane_rows: int = LANE_ROWS


# ---------------------------------------------------------------- numpy helpers


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if rows and flat.size % rows:
        raise ValueError("vectors differ in width")
    return flat.reshape(rows, -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + MATCH_NORM_OFFSET)


def scores(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.round(queries @ docs.T, SCORE_DIGITS)


def best_cells(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the k best columns of each row.

    Columns are in id order, so equal scores are kept from the left: exactly k
    per row even when most scores are equal.
    """
    if sims.shape[1] <= k:
        return np.nonzero(np.ones_like(sims, dtype=bool))
    kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, [sims.shape[1] - k]]
    above, equal = sims > kth, sims == kth
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))


# ------------------------------------------------------------------ collectors
#
# A collector reduces the scores of one set of queries as document blocks go by:
# ``add`` takes a group's key values, the block's document ids (ascending), its
# matrix of products and the places of its queries (default: all). Products are
# rounded here, and only those near a bound, before anything is compared. ``finish``
# hands over what is left. Both yield ``(key values, column, column, ...)``, the
# first column being the query id.


def _cells(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells; over the flat array numpy is much faster than over rows."""
    return np.divmod(np.flatnonzero(chosen), chosen.shape[1])


def _reaching(sims: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded scores of the cells at or above the threshold."""
    q, d = _cells(sims >= threshold - ROUNDING)
    found = np.round(sims[q, d], SCORE_DIGITS)
    kept = found >= threshold
    return q[kept], d[kept], found[kept]


class Hits:
    """Pairs at or above a threshold, handed over block by block."""

    def __init__(self, qids: np.ndarray, threshold: float):
        self.qids, self.threshold = qids, threshold

    def add(self, values, ids, sims, rows=None):
        q, d, found = _reaching(sims, self.threshold)
        if len(q):
            yield values, self.qids[q if rows is None else rows[q]], ids[d], found

    def finish(self):
        return iter(())


class Counts:
    """Documents at or above a threshold, one running count per query and group."""

    def __init__(self, qids: np.ndarray, threshold: float):
        self.qids, self.threshold = qids, threshold
        self.groups: dict[tuple, np.ndarray] = {}

    def add(self, values, ids, sims, rows=None):
        q, _, _ = _reaching(sims, self.threshold)
        held = self.groups.get(values)
        if held is None:
            if (len(self.groups) + 1) * len(self.qids) > STATE_CELLS:
                yield from self.finish()
            held = self.groups[values] = np.zeros(len(self.qids), np.int64)
        held[slice(None) if rows is None else rows] += np.bincount(q, minlength=len(sims))

    def finish(self):
        for values, found in self.groups.items():
            q = np.nonzero(found)[0]
            if len(q):
                yield values, self.qids[q], found[q]
        self.groups = {}


class _Best:
    """Entries of some queries in one group, ``room`` places for each, and each query's k-th score so far."""

    def __init__(self, queries: int, room: int, ids: np.ndarray, notes: np.ndarray | None):
        self.floor = np.full(queries, -np.inf)
        self.scores = np.full((queries, room), -np.inf)
        empty = np.zeros if ids.dtype != object else lambda shape, kind: np.full(shape, ids[0], kind)
        self.columns = [empty((queries, room), ids.dtype), *([] if notes is None else [np.zeros((queries, room), notes.dtype)])]
        self.taken = np.zeros(queries, np.int64)

    def put(self, at: np.ndarray, scores: np.ndarray, *columns: np.ndarray) -> None:
        for table, c in zip((self.scores, *self.columns), (scores, *columns)):
            table.reshape(-1)[at] = c

    def reorder(self, order: np.ndarray) -> None:
        """The places ``order`` of each query come first, nothing comes after them."""
        size = order.shape[1]
        for table in (self.scores, *self.columns):
            table[:, :size] = np.take_along_axis(table, order, axis=1)
        self.scores[:, size:] = -np.inf


class LocalTop:
    """The k best documents seen so far per query and group; equal scores go to the smaller id.

    Entries that reach a query's k-th score are put beside those kept, in places that each
    query has in a matrix; when a query has none left, the k best of each are selected
    without a sort. ``LANE_ROWS`` queries share a matrix; the rows of a block must belong
    to one. With ``distinct`` a document that comes several times counts once, with
    its best score. ``notes`` is a further column of the documents that is handed over
    beside them.
    """

    def __init__(self, qids: np.ndarray, k: int, distinct: bool = False):
        self.qids, self.k, self.distinct = qids, k, distinct
        self.room = max(2 * k, LEAST_ROOM)
        self.groups: dict[tuple, dict[int, _Best]] = {}

    def add(self, values, ids, sims, rows=None, notes=None):
        if values not in self.groups:
            if (len(self.groups) + 1) * len(self.qids) * self.room > STATE_CELLS // 2:
                yield from self.finish()
            self.groups[values] = {}
        if not sims.size:
            return
        rows = np.arange(len(sims)) if rows is None else rows
        base = int(rows[0]) - int(rows[0]) % LANE_ROWS
        rows = (rows - base).astype(np.int32)
        held = self.groups[values].get(base)
        head = max(self.k, sims.shape[1] // 8)
        if held is None:
            queries = max(min(LANE_ROWS, len(self.qids) - base), int(rows[-1]) + 1)
            held = self.groups[values][base] = _Best(queries, self.room, ids, notes)
            # A few documents give the bounds that most of the others fail.
            cuts = [slice(head), slice(head, None)]
        else:
            cuts = [slice(None)]
        for cut in cuts:
            self._take(held, rows, ids[cut], sims[:, cut], None if notes is None else notes[cut])

    def _take(self, held, rows, ids, sims, notes):
        hopeful = sims >= (held.floor[rows] - ROUNDING)[:, None]
        if sims.shape[1] > self.k and np.count_nonzero(hopeful) > sims.size // 3:
            # Most cells would be put: the block's own k best are enough, its k-th score is a bound.
            exact = np.where(hopeful, np.round(sims, SCORE_DIGITS), -np.inf)
            q, d = best_cells(exact, self.k)
            found = exact[q, d]
            held.floor[rows] = np.maximum(held.floor[rows], found.reshape(len(sims), self.k).min(axis=1))
        else:
            q, d = _cells(hopeful)
            found = np.round(sims[q, d], SCORE_DIGITS)
        self._enter(held, rows[q], d, found, ids, notes)

    def add_near(self, values, ids, queries, docs, short, rows):
        """``add`` for the products of unit rows, of which ``short`` has both sides in single precision.

        Once all queries of a matrix have a k-th score, products in single precision
        pass over those that cannot reach it, whatever their rounding; the others are
        taken anew in double precision.
        """
        base = int(rows[0]) - int(rows[0]) % LANE_ROWS
        held = self.groups.get(values, {}).get(base)
        own = rows - base
        if held is not None and held.floor[own].min() > -np.inf:
            slack = ROUNDING + (docs.shape[1] + 4) * 2.0**-22
            hopeful = short[0] @ short[1].T >= (held.floor[own] - slack).astype(np.float32)[:, None]
            if np.count_nonzero(hopeful) <= hopeful.size // 16:
                q, d = _cells(hopeful)
                found = [np.einsum("nw,nw->n", queries[q[at : at + OUT_ROWS]], docs[d[at : at + OUT_ROWS]]) for at in range(0, len(q), OUT_ROWS)]
                found = np.round(np.concatenate([np.zeros(0), *found]), SCORE_DIGITS)
                self._enter(held, own[q], d, found, ids, None)
                return
        yield from self.add(values, ids, queries @ docs.T, rows)

    def _enter(self, held, q, d, found, ids, notes):
        """Put the entries that reach the bounds of their queries; ``q`` ascends."""
        while True:
            kept = (found > -np.inf) & (found >= held.floor[q])
            q, d, found = q[kept], d[kept], found[kept]
            # Entries come query by query, each takes the next place of its query.
            counts = np.bincount(q, minlength=len(held.taken))
            place = held.taken[q] + np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
            fits = place < self.room
            here = slice(None) if fits.all() else fits
            held.put(q[here] * np.int64(self.room) + place[here], found[here], ids[d[here]], *([] if notes is None else [notes[d[here]]]))
            held.taken = np.minimum(held.taken + counts, self.room)
            if fits.all():
                return
            self._select(held)
            q, d, found = q[~fits], d[~fits], found[~fits]

    def _select(self, held):
        """Keep the k best entries of each query."""
        if self.distinct:
            self._join_copies(held)
        scores, k = held.scores, self.k
        order = np.argpartition(scores, self.room - k, axis=1)[:, self.room - k :]
        kept = np.take_along_axis(scores, order, axis=1)
        kth = kept.min(axis=1)
        # Where more entries tie with the k-th than are kept, ids decide.
        tied = (scores == kth[:, None]).sum(axis=1) > (kept == kth[:, None]).sum(axis=1)
        tied = np.flatnonzero(tied & (kth > -np.inf))
        if len(tied):
            order[tied] = np.lexsort((held.columns[0][tied], -scores[tied]), axis=1)[:, :k]
        held.reorder(order)
        held.floor = np.maximum(held.floor, kth)
        held.taken = np.minimum(held.taken, k) if not self.distinct and held.taken.max() <= k else np.full(len(held.taken), k)

    def _join_copies(self, held):
        """One entry for each document of a query, with its best score."""
        scores, names = held.scores, held.columns[0]
        if names.dtype.kind == "i":
            # Empty places come last, each with a name of its own.
            key = np.where(scores > -np.inf, names, np.iinfo(names.dtype).max - np.arange(self.room, dtype=names.dtype))
            order = np.argsort(key, axis=1)
        else:
            order = np.lexsort((-scores, names), axis=1)
        held.reorder(order)
        there, same = scores > -np.inf, np.zeros(scores.shape, dtype=bool)
        same[:, 1:] = (names[:, 1:] == names[:, :-1]) & there[:, 1:] & there[:, :-1]
        if same.any():
            first = np.flatnonzero(~same)
            best = np.maximum.reduceat(scores.reshape(-1), first)
            scores.fill(-np.inf)
            scores.reshape(-1)[first] = best

    def finish(self):
        for values, parts in self.groups.items():
            for base, held in parts.items():
                self._select(held)
                scores, *columns = (c[:, : self.k] for c in (held.scores, *held.columns))
                order = np.lexsort((columns[0], -scores), axis=1)
                scores, *columns = (np.take_along_axis(c, order, axis=1) for c in (scores, *columns))
                there = scores > -np.inf
                q = np.nonzero(there)[0]
                if len(q):
                    names, *notes = (c[there] for c in columns)
                    yield values, self.qids[q + base], names, scores[there], *notes
        self.groups = {}


Collector = Callable[[np.ndarray], "Hits | Counts | LocalTop"]


# ------------------------------------------------------------- shared machinery


def _field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType)


def _measure(df: DataFrame, vec_col: str) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("w")).first()
    return row["n"], row["w"] or 0


def _record(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def _group_runs(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row numbers of each key combination of a batch, in the order in which the batch has them."""
    if not keys:
        yield (), np.arange(table.num_rows)
        return
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for key in keys:
        coded = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    runs = np.split(order, np.nonzero(np.diff(codes[order]))[0] + 1)
    for rows in sorted(runs, key=lambda rows: rows[:1].tolist()):
        if rows.size:
            yield tuple(table.column(k)[int(rows[0])].as_py() for k in keys), rows


def _rows(arrow: pa.Schema, found) -> Iterator[pa.RecordBatch]:
    """Record batches of what a collector hands over."""
    for values, first, *rest in found:
        n = len(first)
        for at in range(0, n, OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            size = min(OUT_ROWS, n - at)
            yield _record(arrow, [first[part], *[[v] * size for v in values], *[c[part] for c in rest]])


def _collected(kept: Hits | Counts | LocalTop, matrix: np.ndarray, docs: pa.Table, keys: Sequence[str], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pass a batch of documents by the unit rows of the queries, block by block."""
    ids, vectors = docs.column("id").to_numpy(), unit_rows(matrix_of(docs.column("vec")))
    ranks = isinstance(kept, LocalTop)
    short = [m.astype(np.float32) for m in (matrix, vectors)] if ranks else None
    for values, rows in _group_runs(docs, keys):
        rows = rows[np.argsort(ids[rows], kind="stable")]
        for low in range(0, len(matrix), LANE_ROWS):
            part = matrix[low : low + LANE_ROWS]
            asked, step = np.arange(low, low + len(part)), max(1, PRODUCT_CELLS // len(part))
            for at in range(0, len(rows), step):
                take = rows[at : at + step]
                if ranks:
                    found = kept.add_near(values, ids[take], part, vectors[take], (short[0][low : low + LANE_ROWS], short[1][take]), asked)
                else:
                    found = kept.add(values, ids[take], part @ vectors[take].T, asked)
                yield from _rows(arrow, found)


def _resident(queries: DataFrame, docs: DataFrame, keys: Sequence[str], collector: Collector, schema: T.StructType) -> DataFrame:
    """Stream documents past the broadcast query matrix."""
    table = queries.select("qid", "vec").toArrow()
    qids = table.column("qid").to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((qids, unit_rows(matrix_of(table.column("vec")))))
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = shared.value
        kept = collector(qids)
        for batch in batches:
            if batch.num_rows:
                yield from _collected(kept, matrix, pa.Table.from_batches([batch]), keys, arrow)
        yield from _rows(arrow, kept.finish())

    rows = docs.select("id", "vec", *keys)
    # Key by key inside a task, so that few groups are open at a time.
    return (rows.sortWithinPartitions(*keys) if keys else rows).mapInArrow(run, schema)


def cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """``(cell, side, rows)`` of batches that are sorted by cell and side."""
    for batch in batches:
        if batch.num_rows:
            cell, side = (batch.column(n).to_numpy() for n in ("__cell", "__side"))
            cuts = np.nonzero((np.diff(cell) != 0) | (np.diff(side) != 0))[0] + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield int(cell[low]), int(side[low]), batch.slice(low, high - low)


def in_cells(sides: Sequence[DataFrame], lanes: int, parts: int, order: Sequence[str] = ()) -> DataFrame:
    """The rows of several tables with ``part`` and ``lane``, cell by cell and side after side in one task.

    A column that a side lacks is null. Cells are numbered, so every task has as many
    as the others; nothing but the rows of the first sides needs to be held, as the rest
    streams in the order named.
    """
    kinds = {f.name: f.dataType for side in sides for f in side.schema.fields if f.name not in ("part", "lane")}
    cells = parts * lanes
    tables = []
    for number, side in enumerate(sides):
        cell = (F.col("part").cast("long") * lanes + F.col("lane")).alias("__cell")
        columns = [F.col(n) if n in side.columns else F.lit(None).cast(kind).alias(n) for n, kind in kinds.items()]
        tables.append(side.select(cell, F.lit(number).alias("__side"), *columns))
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionAll(more)
    tasks = max(1, min(cells, MAX_TASKS))
    dealt = rows.repartitionById(tasks, F.pmod(F.col("__cell"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("__cell", "__side", *order)


def _grid_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], collector: Collector, schema: T.StructType, lanes: int, parts: int) -> DataFrame:
    """Reduce the products of each (part, lane) group of queries and documents.

    ``left`` has ``part, lane, qid, vec``, ``right`` ``part, lane, id, vec`` and the
    keys. Queries of a group are held, documents stream past them key by key, so few
    groups of keys are open at a time, and what is found leaves the task at once.
    """
    arrow = _arrow_schema(schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, kept, matrix = None, [], None, None
        for cell, side, rows in cell_batches(batches):
            if cell != now:
                if kept is not None:
                    yield from _rows(arrow, kept.finish())
                now, asked, kept = cell, [], None
            if side == 0:
                asked.append(rows.select(["qid", "vec"]))
                continue
            if kept is None and asked:
                held = pa.Table.from_batches(asked)
                kept, matrix, asked = collector(held.column("qid").to_numpy()), unit_rows(matrix_of(held.column("vec"))), []
            if kept is not None:
                yield from _collected(kept, matrix, pa.Table.from_batches([rows.select(["id", "vec", *keys])]), keys, arrow)
        if kept is not None:
            yield from _rows(arrow, kept.finish())

    return in_cells([left, right], lanes, parts, keys).mapInArrow(match, schema)


def _dealt(id_col: str, count: int):
    return F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int")


def _each(count: int):
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def _sides(queries: DataFrame, docs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both inputs stored once, as they are measured and read again."""
    wide = F.col("vec").cast("array<double>").alias("vec")
    return stored(queries.select("qid", wide), "match-queries"), stored(docs.select("id", wide, *keys), "match-documents")


def grid_shape(queries: int, docs: int, plan: Plan, *, width: int = 0, state: int = 1) -> tuple[int, int]:
    """Document ranges and query lanes: a query is copied once per range, a document once per lane.

    Either side is copied ``COPIES`` times at most, more only in proportion to a larger
    other side, or where the vectors of a lane, or ``state`` values for each of its
    queries, would not fit in a task.
    """
    ranges = min(-(-docs // plan.range_rows), COPIES * max(1, docs // max(1, queries)))
    lanes = min(-(-queries // plan.lane_rows), COPIES * max(1, queries // max(1, docs)))
    return max(1, ranges), max(1, lanes, -(-queries * width * 8 // RESIDENT_BYTES), -(-queries * state * 4 // STATE_CELLS))


def _grid(queries: DataFrame, docs: DataFrame, keys: Sequence[str], collector: Collector, schema: T.StructType, plan: Plan, state: int) -> DataFrame:
    """All products of the two sides, in groups of bounded memory."""
    queries, docs = _sides(queries, docs, keys)
    count, width = _measure(queries, "vec")
    ranges, lanes = grid_shape(count, docs.count(), plan, width=width, state=state)
    left = queries.select(_dealt("qid", lanes).alias("lane"), "qid", "vec", _each(ranges).alias("part"))
    right = docs.select(_dealt("id", ranges).alias("part"), "id", "vec", *keys, _each(lanes).alias("lane"))
    return _grid_groups(left, right, keys, collector, schema, lanes, ranges)


def _leaf_matrix(docs: DataFrame, leaves: int, fraction: float, seed: int) -> np.ndarray:
    """KMeans centres, trained on all rows or on the caller's ``fraction`` of them."""
    training = docs.select("vec") if fraction >= 1 else docs.select("vec").sample(fraction=fraction, seed=seed)
    model = KMeans(k=leaves, seed=seed, maxIter=20).fit(training.select(array_to_vector("vec").alias("features")))
    return unit_rows(np.array(model.clusterCenters()))


def _nearest_leaves(df: DataFrame, id_col: str, keys: Sequence[str], centres: np.ndarray, count: int) -> DataFrame:
    """The rows with ``leaves``, the numbers of the ``count`` nearest centres."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([_field(df, id_col), _field(df, "vec"), *[_field(df, k) for k in keys], T.StructField("leaves", T.ArrayType(T.IntegerType()))])
    arrow = _arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sims = unit_rows(matrix_of(batch.column("vec"))) @ shared.value.T
                _, cols = best_cells(sims, count)
                leaves = cols.reshape(len(sims), -1).astype(np.int32)
                columns = [batch.column(id_col), batch.column("vec"), *[batch.column(k) for k in keys]]
                yield _record(arrow, [*columns, list(leaves)])

    return df.select(id_col, "vec", *keys).mapInArrow(run, schema)


def leaf_sides(
    visits: DataFrame, docs: DataFrame, sizes: dict[int, int], leaves: int, queries: int, plan: Plan, *, width: int = 0, state: int = 1
) -> tuple[DataFrame, DataFrame, int, int]:
    """Queries and documents with ``part`` and ``lane``, and the numbers of lanes and parts.

    A part belongs to one leaf, and parts are numbered through all leaves. Leaves are
    cut so that a hot one is no hot group; as documents stream, a part may grow with the
    table, and a query is copied ``COPIES`` times beside its visits at most.
    """
    total = sum(sizes.values())
    ranges, lanes = grid_shape(queries, total, plan, width=width, state=state)
    rows = max(1, -(-total // ranges))
    many = [-(-sizes.get(i, 0) // rows) for i in range(leaves)]
    first = np.cumsum([0, *many]).tolist()
    # An empty leaf has no part.
    start, count = (F.get(F.array(*[F.lit(x) for x in xs]), F.col("leaf")) for xs in (first[:-1], many))
    own = F.when(count > 0, F.sequence(start, start + count - 1))
    left = visits.withColumn("lane", _dealt("qid", lanes)).withColumn("part", F.explode(own))
    right = docs.withColumn("part", (start + F.pmod(F.xxhash64("id"), count)).cast("int")).withColumn("lane", _each(lanes))
    return left, right, lanes, max(1, first[-1])


def _row_schema(queries: DataFrame, docs: DataFrame, keys: Sequence[str], *rest: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([_field(queries, "qid"), *[_field(docs, k) for k in keys], *[T.StructField(*r) for r in rest]])


def _clean(df: DataFrame) -> DataFrame:
    return df.filter(F.col("vec").isNotNull())


def _matched(queries, docs, keys, collector, schema, plan, state: int = 1) -> DataFrame:
    """The resident way while the query matrix and ``state`` values for each query fit, else the grid."""
    queries, docs = _clean(queries), _clean(docs)
    n, width = _measure(queries, "vec")
    if n * width * 8 <= plan.resident_bytes and n * state * 4 <= STATE_CELLS:
        return _resident(queries, docs, keys, collector, schema)
    return _grid(queries, docs, keys, collector, schema, plan, state)


# -------------------------------------------------------------------- operators


def similar_pairs(queries: DataFrame, docs: DataFrame, *, threshold: float, keys: Sequence[str] = (), plan: Plan = Plan()) -> DataFrame:
    """Pairs with cosine similarity at or above the threshold: ``(qid, *keys, id, sim)``."""
    schema = _row_schema(queries, docs, keys, ("id", docs.schema["id"].dataType), ("sim", T.DoubleType()))
    return _matched(queries, docs, keys, partial(Hits, threshold=threshold), schema, plan)


def match_counts(
    queries: DataFrame,
    docs: DataFrame,
    *,
    threshold: float,
    keys: Sequence[str] = ("category", "year"),
    k: int | None = None,
    plan: Plan = Plan(),
) -> DataFrame:
    """Documents at or above the threshold among each query's top ``k``, per group.

    The top k is sorted by similarity, so this is the plain count cut at ``k``
    and needs no sort. Groups without a match have no row.
    """
    schema = _row_schema(queries, docs, keys, ("n", T.LongType()))
    counted = _matched(queries, docs, keys, partial(Counts, threshold=threshold), schema, plan)
    total = F.sum("n")
    return counted.groupBy("qid", *keys).agg((total if k is None else F.least(F.lit(k).cast("long"), total)).alias("matches"))


def _ranked(local: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return top_per_group(local, ["qid", *keys], [F.col("sim").desc(), F.col("id").asc()], k, rank="rank")


def top_k(queries: DataFrame, docs: DataFrame, *, k: int, keys: Sequence[str] = (), plan: Plan = Plan()) -> DataFrame:
    """Exact ``k`` most similar documents per query and group: ``(qid, *keys, rank, id, sim)``.

    Equal scores are ordered by id.
    """
    schema = _row_schema(queries, docs, keys, ("id", docs.schema["id"].dataType), ("sim", T.DoubleType()))
    local = _matched(queries, docs, keys, partial(LocalTop, k=k), schema, plan, state=k)
    return _ranked(local, keys, k).select("qid", *keys, "rank", "id", "sim")


def approximate_top_k(
    queries: DataFrame,
    docs: DataFrame,
    *,
    k: int,
    keys: Sequence[str] = (),
    leaves: int = 200,
    leaves_to_search: int = 100,
    training_fraction: float = 1.0,
    seed: int = 42,
    plan: Plan = Plan(),
) -> DataFrame:
    """Top ``k`` among the documents of the ``leaves_to_search`` nearest KMeans leaves.

    Centres are trained on all documents unless the caller names a smaller
    ``training_fraction``. Scores inside the searched leaves are exact; with all
    leaves searched the result is the exact one. A leaf is cut into as many parts of
    about ``range_rows`` documents as its size asks for, so a hot leaf is no hot group.
    """
    queries, docs = _sides(_clean(queries), _clean(docs), keys)
    schema = _row_schema(queries, docs, keys, ("id", docs.schema["id"].dataType), ("sim", T.DoubleType()))
    centres = _leaf_matrix(docs, leaves, training_fraction, seed)
    count = len(centres)
    placed = stored(_nearest_leaves(docs, "id", keys, centres, 1).withColumn("leaf", F.get("leaves", F.lit(0))).drop("leaves"), "match-leaves")
    # One row per leaf.
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    asked, width = _measure(queries, "vec")
    visits = _nearest_leaves(queries, "qid", [], centres, min(leaves_to_search, count)).select("qid", "vec", F.explode("leaves").alias("leaf"))
    left, right, lanes, parts = leaf_sides(visits, placed, sizes, count, asked, plan, width=width, state=k)
    local = _grid_groups(left.select("part", "lane", "qid", "vec"), right.select("part", "lane", "id", "vec", *keys), keys, partial(LocalTop, k=k), schema, lanes, parts)
    return _ranked(local, keys, k).select("qid", *keys, "rank", "id", "sim")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def top_k_for(docs: DataFrame, query: Sequence[float], *, k: int = 10) -> DataFrame:
    """The ``k`` documents with the largest raw dot product with one vector."""
    from taskatlas.functions.vectors import as_double, dot

    target = F.array(*[F.lit(float(x)) for x in query])
    scored = docs.select("id", F.round(dot(as_double(F.col("vec")), target), SCORE_DIGITS).alias("sim"))
    return scored.orderBy(F.col("sim").desc(), F.col("id").asc()).limit(k)


def neighbour_lists(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long neighbour rows to one row per query and group with ordered lists (at most k entries)."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "id", "sim")))
    return ranked.groupBy("qid", *keys).agg(entries.alias("neighbours"))


def neighbour_rows(lists: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return lists.select("qid", *keys, F.explode("neighbours").alias("n")).select("qid", *keys, "n.rank", "n.id", "n.sim")
