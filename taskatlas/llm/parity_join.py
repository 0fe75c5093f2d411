"""Jaccard links between word-shingle sets by parity sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from taskatlas.llm.components import components
from taskatlas.operators.ranking import top_per_group
from taskatlas.sources.storage import stored

ANCHORS = 2  # members of a key compared with its other members in the second round
MORE_ANCHORS = 32  # how many times as many in each further round
LANE = 128  # texts compared with one text in one group
LANE_ROWS = 4_096  # members of a key whose whole sketches meet in one group
GROUP_ROWS = 16_384  # rows of one group, of many small keys together
PAIRS_AT_ONCE = 1 << 16  # whole sketches compared by one step in numpy
SKETCH_MOST = 4_096  # bits of a whole sketch; longer sets only lose sharpness
RATIO = 1.5  # growth of the size bands
FILLED_MOST = (1 << 22) - 1
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted different 64-bit hashes of all runs of ``width`` words; of the whole list when it is shorter."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < width:
        return np.array([xxh3_64_intdigest(b" ".join(tokens), seed=n)], dtype=np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        total = (total ^ (each[i : n - width + 1 + i] * MULTIPLIERS[i % 5])) * MULTIPLIERS[(i + 1) % 5] + np.uint64(i + 1)
    return np.unique(mixed(total))


def set_class(values: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set: equal sets have equal names."""
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_edges(most: int) -> list[int]:
    """Lower ends of the size bands, up to beyond ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, math.floor(edges[-1] * RATIO)))
    return edges


class Bands:
    """Sizes and parts of the sketches.

    Sets of sizes a <= b with Jaccard of at least t = p / 100 differ in at most
    (a + b) (1 - t) / (1 + t) elements, so in at most that many parts. With b <= a / t
    that is ``smaller(a)``; a larger one has at most ``larger(b)``. A band has more
    parts than ``smaller`` of its largest size, with room for empty parts.
    """

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]

    def smaller(self, size: int) -> int:
        p = self.percent
        # b = floor(100 a / p)
        return (size + 100 * size // p) * (100 - p) // (100 + p)

    def larger(self, size: int) -> int:
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def number(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges = band_edges(2 * size)
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def parts(self, band: int) -> int:
        self.number(self.edges[band])
        most = self.smaller(self.edges[band + 1] - 1)
        return most + 1 + math.ceil(0.06 * most) + 4

    def of(self, size: int) -> range:
        """Bands of the smaller partners a set of this size can have, its own last."""
        return range(self.number(-(-size * self.percent // 100)), self.number(size) + 1)


def sketch(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per part of the elements: their hashes XORed, and their number."""
    part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    present, first, counts = np.unique(part[order], return_index=True, return_counts=True)
    words, sizes = np.zeros(parts, dtype=np.uint64), np.zeros(parts, dtype=np.int64)
    at = present.astype(np.int64)
    words[at], sizes[at] = np.bitwise_xor.reduceat(mixed(values[order] + np.uint64(1)), first), counts
    return words, sizes


def keys_of(values: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, int]:
    """Join keys of a set, whether each is of its own band, and its filled parts there.

    A key names band, part and content. A set shows its filled parts. Empty parts are
    keys only for a set with so few filled parts that the differing ones could be all
    of them; the number of filled parts is then given as 0.
    """
    size, keys, own = len(values), [], []
    home, filled_at_home = bands.number(size), 0
    for band in bands.of(size):
        parts = bands.parts(band)
        words, counts = sketch(values, parts)
        name = mixed(words + mixed(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32) + (counts.astype(np.uint64) << np.uint64(48))))
        filled = int((counts > 0).sum())
        few = filled <= (bands.smaller(size) if band == home else bands.larger(size))
        shown = name if few else name[counts > 0]
        keys.append(shown)
        own.append(np.full(len(shown), band == home))
        if band == home and not few:
            filled_at_home = filled
    return np.concatenate(keys).view(np.int64), np.concatenate(own), filled_at_home


def _rows(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``key, cls, meta, doc_id``: the keys of each different set of a task, and one row with
    ``doc_id`` for each document. ``meta`` of a key is the set's filled parts times 2**40,
    plus twice its size, plus 1 for a key of its own band; of a document -1 less the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()

        def flush(columns: list[list[np.ndarray]], ids: list[int | None]) -> pa.RecordBatch:
            key, cls, meta = (np.concatenate(c) for c in columns)
            doc = pa.concat_arrays([pa.nulls(len(key) - len(ids), pa.int64()), pa.array(ids, pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(meta), doc], names=["key", "cls", "meta", "doc_id"])

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
                ids, own = [], []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    values = shingles(text.as_py(), width)
                    name = set_class(values)
                    ids.append(doc_id)
                    own.append((name, -1 - len(values)))
                    if len(values) and name not in seen:
                        # Copies in this task would only repeat the keys.
                        seen.add(name)
                        keys, at_home, filled = keys_of(values, bands)
                        # Fewer filled parts than there are only make more keys strong.
                        meta = (min(filled, FILLED_MOST) << 40) + 2 * len(values) + at_home.astype(np.int64)
                        for c, x in zip(columns, (keys, np.full(len(keys), name), meta), strict=True):
                            c.append(x)
                names = np.array(own, dtype=np.int64).reshape(-1, 2)
                # A document's row goes anywhere: its key only spreads the rows.
                spread = mixed(np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64)).view(np.int64)
                for c, x in zip(columns, (spread, names[:, 0], names[:, 1]), strict=True):
                    c.append(x)
                yield flush(columns, ids)

    return documents.mapInArrow(run, "key long, cls long, meta long, doc_id long")


def verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets have the Jaccard similarity.

    ``texts`` has ``cls, text``. The texts of a class and of at most about LANE
    partners meet in one group; a class with more partners is copied to several.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    spread = pairs.join(degree, "a").withColumn("lane", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / LANE)))
    # The first partner of a lane brings the class itself along.
    first = F.row_number().over(Window.partitionBy("a", "lane").orderBy("b")) == 1
    places = spread.select("a", "lane", "b", first.alias("first")).select("a", "lane", F.explode(F.when(F.col("first"), F.array("b", "a")).otherwise(F.array("b"))).alias("cls"))
    placed = places.join(texts, "cls").select("a", "lane", "cls", "text")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        hub = group["a"][0].as_py()
        sets = {}
        for cls, text in zip(group["cls"].to_pylist(), group["text"], strict=True):
            values = shingles(text.as_py(), width)
            # Rows that share an id may hold other texts.
            if cls not in sets and set_class(values) == cls:
                sets[cls] = values
        mine = sets.pop(hub, None)
        linked = []
        for cls, values in sets.items():
            if mine is not None:
                short, long = sorted((mine, values), key=len)
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                common = int((long[at] == short).sum())
                if 100 * common >= percent * (len(mine) + len(values) - common):
                    linked.append(cls)
        return pa.table([pa.array([hub] * len(linked), pa.int64()), pa.array(linked, pa.int64())], schema=out)

    return placed.groupBy("a", "lane").applyInArrow(compare, "a long, b long")


def shared_keys(rows: DataFrame, percent: int) -> DataFrame:
    """``key, cls, n, strong`` of the keys that could find a link.

    As the smaller partner a set of n elements needs only ``smaller(n)`` + 1 of its
    own parts, as at most ``smaller(n)`` can differ, and it may choose: parts that no
    other set has come first, then those that the fewest have. Only what is missing to
    that number is strong, so a passage that unlinked texts share makes no pairs. A
    set with few filled parts keeps all. Keys without a strong member are left out.
    """
    members = rows.select("key", "cls", F.expr("meta >> 40").alias("filled"), F.expr("(meta & ((1L << 40) - 1)) div 2").alias("n"), (F.col("meta") % 2 == 1).alias("own"), "seen")
    by_class = Window.partitionBy("cls").orderBy(F.col("own").desc(), "seen", "key")
    whole = Window.partitionBy("cls")
    allowed = (F.col("n") + F.expr(f"100 * n div {percent}")) * (100 - percent)
    needed = F.expr(f"allowed div {100 + percent}") + 1 - (F.col("filled") - F.count_if("own").over(whole))
    ranked = members.distinct().withColumn("allowed", allowed).withColumn("needed", needed).withColumn("place", F.row_number().over(by_class))
    strong = F.col("own") & ((F.col("filled") == 0) | (F.col("place") <= F.col("needed")))
    marked = ranked.select("key", "cls", "n", strong.alias("strong"))
    alive = F.max("strong").over(Window.partitionBy("key"))
    return marked.withColumn("alive", alive).filter("alive").drop("alive")


def whole_sketch(values: np.ndarray, bands: Bands) -> np.ndarray:
    """Parity bits of all elements: two sets differ in at least as many elements as in bits.

    Its length is a power of two, so a longer sketch folds onto a shorter one.
    """
    bits = 64
    while bits < min(16 * bands.smaller(len(values)), SKETCH_MOST):
        bits *= 2
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketched(held: DataFrame, width: int, percent: int) -> DataFrame:
    """``cls, sketch`` of the classes of ``held``; row-local. A text that is not of its class has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            classes, sketches = [], []
            for cls, text in zip(batch["cls"].to_pylist(), batch["text"], strict=True):
                values = shingles(text.as_py(), width)
                if set_class(values) == cls:
                    classes.append(cls)
                    sketches.append(whole_sketch(values, bands).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sketches, pa.binary())], names=["cls", "sketch"])

    return held.mapInArrow(run, "cls long, sketch binary").dropDuplicates(["cls"])


def folded(sketches: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The sketches of these rows, of ``size`` or twice as many bytes, as 64-bit words of ``size`` bytes."""
    table = np.zeros((len(rows), size), dtype=np.uint8)
    for i, row in enumerate(rows):
        sketch = np.frombuffer(sketches[row].as_buffer(), dtype=np.uint8)
        table[i] = sketch if len(sketch) == size else sketch[:size] ^ sketch[size:]
    return table.view(np.uint64)


def close_pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes of a group that share a key and lane and whose whole sketches are
    close enough for a link: each anchor against the members of other components."""
    group = group.sort_by([("key", "ascending"), ("lane", "ascending"), ("anchor", "ascending")])
    key, lane, cls, n, component = (group[c].to_numpy() for c in ("key", "lane", "cls", "n", "component"))
    anchor, strong = (group[c].to_numpy(zero_copy_only=False) for c in ("anchor", "strong"))
    sketches = group["sketch"].combine_chunks()
    sizes = np.array([len(s.as_buffer()) for s in sketches], dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lane[1:] != lane[:-1])])
    segment = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
    members = np.bincount(segment[~anchor], minlength=len(starts))  # they come first in their segment
    hubs = np.flatnonzero(anchor)
    ends = np.cumsum(members[segment[hubs]])
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found = [np.empty((2, 0), dtype=np.int64)]
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        at = np.arange(low, min(low + PAIRS_AT_ONCE, ends[-1]))
        hub = np.searchsorted(ends, at, "right")
        x = hubs[hub]
        y = starts[segment[x]] + at - (ends[hub] - members[segment[x]])
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fits = (component[x] != component[y]) & (100 * small >= percent * large)
        fits &= (strong[x] & (n[x] <= n[y])) | (strong[y] & (n[y] <= n[x]))
        x, y, most = x[fits], y[fits], ((small + large) * (100 - percent) // (100 + percent))[fits]
        shared = np.minimum(sizes[x], sizes[y])
        for size in np.unique(shared):
            if size not in tables:
                rows = np.flatnonzero((sizes == size) | (sizes == 2 * size))
                place = np.zeros(len(sizes), dtype=np.int64)
                place[rows] = np.arange(len(rows))
                tables[size] = place, folded(sketches, rows, int(size))
            place, words = tables[size]
            of = np.flatnonzero(shared == size)
            apart = np.bitwise_count(words[place[x[of]]] ^ words[place[y[of]]]).sum(axis=1, dtype=np.int64)
            of = of[apart <= most[of]]
            pair = np.stack([cls[x[of]], cls[y[of]]])
            found.append(np.sort(pair, axis=0))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return a, b


def close_candidates(anchors: DataFrame, members: DataFrame, sketches: DataFrame, most: int, percent: int) -> DataFrame:
    """``a, b``: anchors and other members of their keys that whole sketches leave as possible links.

    A key's members (``held`` of them) are dealt to lanes of bounded size, each with all anchors of the key,
    so no join makes pairs and only those that remain leave a group.
    """
    columns = ["key", "cls", "n", "strong", "component"]
    lanes = F.ceil(F.col("held") / max(LANE_ROWS, 2 * most))
    wanted = members.join(anchors.select("key").distinct(), "key", "left_semi")
    dealt = wanted.select(*columns, F.pmod(F.xxhash64("cls"), lanes).alias("lane"), F.lit(False).alias("anchor"))
    copied = anchors.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1)).alias("lane"), F.lit(True).alias("anchor"))
    groups = -(-members.count() // GROUP_ROWS)
    placed = dealt.union(copied).join(sketches, "cls").withColumn("group", F.pmod(F.xxhash64("key", "lane"), F.lit(groups)))

    def compare(group: pa.Table) -> pa.Table:
        a, b = close_pairs(group, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("group").applyInArrow(compare, "a long, b long").distinct()


def _candidates(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of the two sides that share a key, fit in size and of which the smaller shows a strong key."""
    x, y = left.alias("x"), right.alias("y")
    fits = (
        (F.col("x.cls") != F.col("y.cls"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & ((F.col("x.strong") & (F.col("x.n") <= F.col("y.n"))) | (F.col("y.strong") & (F.col("y.n") <= F.col("x.n"))))
    )
    return x.join(y, "key").filter(fits).select("x.cls", F.col("y.cls").alias("other"))


def jaccard_components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: ``doc_id, n_shingles, component_id``.

    Two documents link when their sets of ``width``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; the component is the smallest id
    reachable by links. Exact: every pair that could link shares a key of the parity
    sketches, and the keys that could find a link are worked off until all their
    members are in one component or compared:

    1. Each class of equal sets is compared with the class it shares most keys with,
       out of the first members of its keys.
    2. In keys that still hold several components, members outside the largest one are
       compared with all members of other components: at most ANCHORS per key, then
       MORE_ANCHORS times as many in each further round, until none is left. Whole sketches
       are compared first, in groups of bounded size: their Hamming distance is at most the
       symmetric difference, so only pairs within its bound go on to the texts.

    A null id takes no part and has no component; a null or empty text has no
    shingles and is its own component. Repeated rows repeat. An empty table gives no
    rows, other columns are ignored. Runs jobs while the plan is built.
    """
    return _named_rows(documents, id_col, text_col, width, percent).drop("cls")


def _named_rows(documents: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The rows of ``jaccard_components`` with the class of each row's set."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    by_key = Window.partitionBy("key")
    rows = _rows(texts, width, percent).withColumns(
        {"least": F.min("cls").over(by_key), "most": F.max("cls").over(by_key), "seen": F.count("*").over(by_key)}
    )
    table = stored(rows.filter("meta < 0 OR least <> most").drop("least", "most"), "parity-keys")
    sized = table.filter("meta < 0").select("doc_id", "cls", (-1 - F.col("meta")).alias("n_shingles"))
    members = stored(shared_keys(table.filter("meta >= 0"), percent), "parity-members")
    classes = stored(sized.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "parity-classes")
    wanted = classes.join(members.select("cls").distinct(), "cls")
    held = stored(texts.join(wanted, "doc_id").select("cls", "text"), "parity-texts")
    # Round 1.
    first = members.groupBy("key").agg(F.min_by(F.struct("cls", "n", "strong"), "cls").alias("f")).select("key", "f.*")
    shares = _candidates(first, members, percent).groupBy("cls", "other").agg(F.count("*").alias("keys"))
    best = top_per_group(shares, ["other"], [F.col("keys").desc(), F.col("cls")], 1)
    links = stored(verified(held, best.select(F.col("cls").alias("a"), F.col("other").alias("b")), width, percent), "parity-links")
    joined = components(links).withColumnRenamed("node", "cls")
    found = stored(wanted.select("cls").join(joined, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component")), "parity-found")
    # Round 2 and later ones.
    done, most, sketches = None, ANCHORS, None
    while True:
        at = members.join(found, "cls")
        sizes = at.groupBy("key", "component").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("components"), F.sum("n").alias("held"))
        # Only keys that are still split go on; their members shrink from round to round.
        members = stored(at.join(largest.filter("components > 1"), "key").drop("components"), "parity-split")
        outside = members.filter("component <> largest")
        if done is not None:
            outside = outside.join(done, ["key", "cls"], "left_anti")
        anchors = stored(top_per_group(outside, ["key"], [F.col("cls")], most).drop("largest"), "parity-anchors")
        members = members.drop("largest")
        if not anchors.limit(1).count():
            break
        if sketches is None:
            sketches = stored(sketched(held.join(members.select("cls").distinct(), "cls"), width, percent), "parity-sketches")
        pairs = stored(close_candidates(anchors, members, sketches, most, percent), "parity-pairs")
        more = stored(verified(held, pairs, width, percent), "parity-links")
        if more.limit(1).count():
            # Only the components that new links touch are joined anew.
            lifted = more.join(found.select(F.col("cls").alias("a"), F.col("component").alias("u")), "a").join(found.select(F.col("cls").alias("b"), F.col("component").alias("v")), "b")
            merged = components(lifted.select("u", "v")).select(F.col("node").alias("component"), F.col("component").alias("least"))
            found = stored(found.join(merged, "component", "left").select("cls", F.coalesce("least", "component").alias("component")), "parity-found")
        tested = anchors.select("key", "cls")
        done = tested if done is None else done.union(tested)
        members, most = members.drop("component", "held"), MORE_ANCHORS * most
    least = classes.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = least.select("cls", "component").join(names, "component").select("cls", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sized.join(named, "cls", "left").select("doc_id", "n_shingles", component.alias("component_id"), "cls")


def one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, of each component the one with the smallest id.

    Rows with a null id stay. Of rows that share an id each is judged by its own text,
    and those with equal texts are reduced to one.
    """
    rows = stored(_named_rows(documents, id_col, text_col, width, percent), "parity-rows")
    copies = rows.filter("component_id <> doc_id").select(F.col("doc_id").alias(id_col), F.col("cls").alias("__cls")).distinct()
    repeated = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(id_col))
    repeated = stored(repeated, "parity-repeated")
    if not repeated.limit(1).count():
        return documents.join(copies, id_col, "left_anti").select(*documents.columns)
    kept = documents.join(repeated, id_col, "left_anti").join(copies, id_col, "left_anti")
    single = _with_class(documents.join(repeated, id_col, "left_semi"), text_col, width).join(copies, [id_col, "__cls"], "left_anti")
    single = single.withColumn("__text", F.xxhash64(text_col)).dropDuplicates([id_col, "__text"])
    return kept.select(*documents.columns).unionByName(single.select(*documents.columns))


def _with_class(documents: DataFrame, text_col: str, width: int) -> DataFrame:
    """The documents with the class of each row's set as ``__cls``; row-local."""
    rows = documents.withColumn("__cls", F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = pa.array([set_class(shingles(t.as_py(), width)) for t in batch["__cls"]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], classes], names=batch.schema.names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("__cls", T.LongType())]))
