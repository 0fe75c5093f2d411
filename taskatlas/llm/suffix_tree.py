"""Language-model scores by a probabilistic suffix tree over words, kept and read as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taskatlas.llm.samples import fold
from taskatlas.llm.token_hashes import END, token_hashes
from taskatlas.llm.word_grams import GramTable, chained, frequent_grams, long_tasks, table_bits, text_runs
from taskatlas.sources.storage import stored

HELD_ROWS = 1_000_000
BLOCK_BYTES = 64 << 20
LEAST_BYTES = 8 << 20
# Text for each range of hashes that is counted and answered at once.
PART_BYTES = 16 << 20
MAX_TASKS = 1_024


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token hashes of runs of texts, which of them are words, and the tokens of each text (its end is the last)."""
    for part in text_runs(batch):
        hashes, lengths = token_hashes(part["text"])
        inner = np.ones(len(hashes), dtype=bool)
        inner[np.cumsum(lengths) - 1] = False
        yield hashes, inner, lengths


Knows = Callable[[int, np.ndarray], np.ndarray]


def _grams(hashes: np.ndarray, inner: np.ndarray, longest: int, knows: Knows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 2 .. ``longest`` tokens of one text: k, their places, hashes, and hashes without the last and without the first.

    ``knows(k, hashes)`` says which sequences count; only those grow, and only at known ones.
    """
    at, shorter = np.arange(len(hashes)), hashes
    there = np.ones(len(hashes), dtype=bool)
    for k in range(2, longest + 1):
        last = at + k - 1
        go = last < len(hashes)
        go[go] = inner[last[go] - 1] & there[at[go] + 1]
        at, last = at[go], last[go]
        grams = chained(shorter[at], hashes[last])
        known = knows(k, grams)
        at, grams = at[known], grams[known]
        yield k, at, grams, shorter[at], shorter[at + 1]
        shorter, there = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), dtype=bool)
        shorter[at], there[at] = grams, True


def _grams_of(depth: int, packed=None, bits: int = 0):
    """For ``frequent_grams``: pairs, or with a table of these all longer sequences of frequent pairs."""

    def start():
        table = packed and GramTable(packed.value, bits)

        def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for hashes, inner, _ in _streams(batch):
                inside = np.nonzero(inner[:-1])[0]
                grams = chained(hashes[inside], hashes[inside + 1])
                if table is None:
                    yield grams
                    continue
                known = table.frequent(grams)
                at, grams = inside[known], grams[known]
                joined = np.zeros(len(hashes), dtype=bool)
                joined[at] = True
                for k in range(3, depth + 2):
                    go = joined[at + k - 2]
                    at, grams = at[go], grams[go]
                    grams = chained(grams, hashes[at + k - 1])
                    yield grams

        return read

    return start


# ------------------------------------------------------------ counts of blocks
#
# Between tasks, words and sequences travel by ranges of their hashes: a row holds the
# range (``part``), the block and arrays as bytes.


class _Held:
    """Rows of a block, a key first and a count last, that are brought together when they are many."""

    def __init__(self, columns: int):
        self.columns, self.rows, self.most = [[] for _ in range(columns)], 0, HELD_ROWS

    def add(self, *columns: np.ndarray) -> bool:
        """Whether there are too many different rows to go on."""
        for held, c in zip(self.columns, columns):
            held.append(c)
        self.rows += len(columns[0])
        if self.rows <= self.most:
            return False
        merged = self._merged()
        self.columns, self.rows = [[c] for c in merged], len(merged[0])
        self.most = self.rows + HELD_ROWS
        return self.rows > 2 * HELD_ROWS

    def _merged(self) -> list[np.ndarray]:
        """Rows in the order of their keys, equal ones as one; what is held is let go column by column."""
        order, found = None, []
        while self.columns:
            c = np.concatenate(self.columns.pop(0))
            order = np.argsort(c) if order is None else order
            found.append(c[order])
        first = _first_of_runs(found[:-1])
        return [*(c[first] for c in found[:-1]), np.add.reduceat(found[-1], first, dtype=np.uint32) if len(first) else found[-1]]

    def take(self) -> list[np.ndarray] | None:
        count, found = len(self.columns), self._merged() if self.rows else None
        self.__init__(count)
        return found


def _first_of_runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.nonzero(new)[0]


def _block_counts(batches: Iterator[pa.RecordBatch], tables: list, bits: int, depth: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``block, [key, prefix, suffix, k, n]`` sorted by key: words (k = 1) and frequent sequences, with their counts in training texts.

    What one task reads of a block is counted together; the rows of a block should follow each other.
    """
    short, long = (GramTable(t.value, bits) for t in tables)
    number, words, longer = None, _Held(2), _Held(5)

    def knows(k: int, grams: np.ndarray) -> np.ndarray:
        return (short if k == 2 else long).frequent(grams)

    def taken() -> Iterator[tuple[int, list[np.ndarray]]]:
        if found := words.take():
            none = np.zeros(len(found[0]), np.uint64)
            yield number, [found[0], none, none, np.ones(len(none), np.uint8), found[1]]
        if found := longer.take():
            yield number, found

    for batch in batches:
        owners, learns = batch["block"].to_numpy(), ~batch["held_out"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero(np.diff(owners))[0] + 1).tolist(), len(owners)]
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            if owners[low] != number:
                yield from taken()
                number = int(owners[low])
            at = low
            for hashes, inner, lengths in _streams(batch.slice(low, high - low)):
                learned = np.repeat(learns[at : at + len(lengths)], lengths)
                at += len(lengths)
                full = False
                for side, count in ((learned, True), (~learned, False)):
                    keys, n = np.unique(hashes[side], return_counts=True)
                    full |= words.add(keys, (n if count else n * 0).astype(np.uint32))
                for k, p, *keys in _grams(hashes, inner, depth + 1, knows):
                    full |= longer.add(*keys, np.full(len(p), k, np.uint8), learned[p].astype(np.uint32))
                if full:
                    yield from taken()
    yield from taken()


def _met(blocks: DataFrame, tables: list, bits: int, depth: int) -> DataFrame:
    """``block, k, key, prefix, suffix, n``: the counts of ``blocks`` (``block, held_out, text``) row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (*keys, k, n) in _block_counts(batches, tables, bits, depth):
            columns = [np.full(len(n), block), k.astype(np.int32), *(key.view(np.int64) for key in keys), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["block", "k", "key", "prefix", "suffix", "n"])

    return blocks.sortWithinPartitions("block").select("block", "held_out", "text").mapInArrow(run, "block long, k int, key long, prefix long, suffix long, n long")


def _edges(keys: np.ndarray, part_bits: int) -> list[int]:
    """Where the ranges of sorted keys begin and end."""
    inner = np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits) if part_bits else np.zeros(0, np.uint64)
    return [0, *np.searchsorted(keys, inner).tolist(), len(keys)]


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


COUNTED = "part int, block long, key binary, prefix binary, suffix binary, k binary, n binary"
MERGED = "kind int, part int, block long, keys binary, c binary, k int, gram long, prefix long, suffix long, n long"
ROW, TOTAL, WORDS, ASKED = range(4)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _counted(blocks: DataFrame, tables: list, bits: int, depth: int, part_bits: int) -> DataFrame:
    """The counts of blocks as ``COUNTED`` rows; a block whose rows are few is one row for each part that it meets."""
    schema = _arrow(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, columns in _block_counts(batches, tables, bits, depth):
            edges = _edges(columns[0], part_bits)
            for part, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
                if low < high:
                    key, prefix, suffix, k, n = (c[low:high] for c in columns)
                    parts = {}
                    if k[0] > 1:
                        # Words have no parts, and a pair is told by its own.
                        key, parts = key[k > 2], {"prefix": prefix.tobytes(), "suffix": suffix.tobytes()}
                    yield _batch(schema, [{"part": part, "block": block, "key": key.tobytes(), "k": k.tobytes(), "n": n.tobytes(), **parts}])

    return blocks.select("block", "held_out", "text").mapInArrow(run, COUNTED)


def _dealt(rows: DataFrame, column: str, count: int, *order: str) -> DataFrame:
    """Rows of a number together, in one task for each where they are not too many."""
    tasks = max(1, min(count, MAX_TASKS))
    dealt = rows.repartitionById(tasks, F.pmod(F.col(column), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions(column, *order) if order or count > tasks else dealt


def _by_number(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            numbers = batch[column].to_numpy()
            cuts = np.nonzero(np.diff(numbers))[0] + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield int(numbers[low]), batch.slice(low, high - low)


def _arrays(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _merged_parts(counted: DataFrame, min_next: int, part_bits: int) -> DataFrame:
    """``MERGED`` rows of each part: every word or sequence seen ``min_next`` times or more, the tokens (n) and words (gram)
    of the part, and for each block its words with their counts and its sequences."""
    schema = _arrow(MERGED)

    def merge(part: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        blocks, ns, ks = table["block"].to_numpy(), _arrays(table["n"], np.uint32), _arrays(table["k"], np.uint8)
        one = np.array([k[0] == 1 for k in ks], dtype=bool)
        for words in (True, False):
            mine = np.nonzero(one == words)[0]
            if not len(mine):
                continue
            n, k = (np.concatenate([x[i] for i in mine]) for x in (ns, ks))
            sent, *parts = (np.concatenate(_arrays(table[name].take(pa.array(mine)), np.uint64)) for name in (["key"] if words else ["key", "prefix", "suffix"]))
            key = sent
            if not words:
                key = chained(*parts)
                key[k > 2] = sent
            order = np.argsort(key)
            first = _first_of_runs([c[order] for c in ([key] if words else [key, *parts, k])])
            total = np.add.reduceat(n[order].astype(np.int64), first)
            # What each place has in all.
            of = np.empty(len(key), np.int64)
            of[order] = np.repeat(total, np.diff([*first, len(order)]))
            if words:
                yield _batch(schema, [{"kind": TOTAL, "n": int(total.sum()), "gram": int((total > 0).sum())}])
            often = order[first[total >= min_next]]
            none = np.zeros(len(often), np.int64)
            for at in range(0, len(often), 50_000):
                here = often[at : at + 50_000]
                named = {
                    "kind": np.full(len(here), ROW, np.int32), "k": k[here].astype(np.int32), "gram": key[here].view(np.int64),
                    "prefix": none[: len(here)] if words else parts[0][here].view(np.int64), "suffix": none[: len(here)] if words else parts[1][here].view(np.int64), "n": of[here],
                }
                yield pa.RecordBatch.from_arrays([pa.array(named[f.name], f.type) if f.name in named else pa.nulls(len(here), f.type) for f in schema], schema=schema)
            ends = np.cumsum([len(ns[i]) for i in mine])
            for i, end in zip(mine, ends):
                own = slice(end - len(ns[i]), end)
                rows_of = {"part": part, "block": int(blocks[i])}
                if words and of[own].any():
                    known = of[own] > 0
                    yield _batch(schema, [rows_of | {"kind": WORDS, "keys": key[own][known].tobytes(), "c": of[own][known].tobytes()}])
                # A word is a state of the tree too.
                yield _batch(schema, [rows_of | {"kind": ASKED, "keys": key[own][of[own] >= min_next].tobytes()}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part, rows in _by_number(batches, "part"):
            if part != now and held:
                yield from merge(now, held)
                held = []
            now = part
            held.append(rows)
        if held:
            yield from merge(now, held)

    return _dealt(counted, "part", 1 << part_bits).mapInArrow(run, MERGED)


def learn_tree(counts: DataFrame, n_tokens: int, depth: int) -> DataFrame:
    """``key, a, b``: the retained states and their transitions, from counts ``k, gram, prefix, suffix, n``.

    The state of a context is retained if its next-token distribution diverges from that
    of the context without its first word: 2 N KL >= T ln N, with N occurrences and T
    known next tokens (the others are one class). The suffixes of a retained
    state are retained too. Where state and token are known, ``P = a + b P'`` with
    P' from the next shorter state; ``b`` belongs to the state, ``a`` to state and token.
    """
    share = F.col("n") / F.lit(float(max(n_tokens, 1)))
    contexts = counts.select(F.col("gram").alias("prefix"), F.col("n").alias("occurrences"), F.col("suffix").alias("shorter"))
    moves = counts.filter("k > 1").join(contexts, "prefix").withColumn("q", F.col("n") / F.col("occurrences"))
    moves = stored(moves.select("k", "gram", "prefix", "suffix", "n", "occurrences", "shorter", "q"), "tree-moves")
    shorter = moves.select("gram", "q").unionByName(counts.filter("k = 1").select("gram", share.alias("q")))
    compared = moves.join(shorter.select(F.col("gram").alias("suffix"), F.col("q").alias("q_shorter")), "suffix")
    states = compared.groupBy((F.col("k") - 1).alias("k"), "prefix", "shorter", "occurrences").agg(
        F.sum("n").alias("known"), F.count("*").alias("kinds"),
        F.sum(F.col("n") * F.log(F.col("q") / F.col("q_shorter"))).alias("gain"), F.sum("q_shorter").alias("met"),
    )
    other = F.col("occurrences") - F.col("known")
    rest = F.when(other > 0, other * F.log(other / F.col("occurrences") / F.greatest(1 - F.col("met"), F.lit(1e-300)))).otherwise(0.0)
    diverges = 2 * (F.col("gain") + rest) >= F.col("kinds") * F.log("occurrences")
    states = stored(states.select("k", "prefix", "shorter", "occurrences", "known", "kinds", diverges.alias("diverges")), "tree-states")

    kept = [states.filter((F.col("k") == depth) & F.col("diverges"))]
    for k in range(depth - 1, 0, -1):
        wanted = kept[-1].select(F.col("shorter").alias("prefix"), F.lit(True).alias("wanted")).distinct()
        of_length = states.filter(F.col("k") == k).join(wanted, "prefix", "left")
        kept.append(of_length.filter(F.col("diverges") | F.col("wanted")).drop("wanted"))
    retained = stored(reduce(DataFrame.unionByName, kept).select("prefix", "occurrences", "known", "kinds"), "tree-retained")
    total = F.col("occurrences") + F.col("kinds")
    back = retained.select(F.col("prefix").alias("key"), F.lit(None).cast("double").alias("a"), ((total - F.col("known")) / total).alias("b"))
    onward = moves.select("gram", "prefix", "n").join(retained.select("prefix", total.alias("total")), "prefix")
    onward = onward.select(F.col("gram").alias("key"), (F.col("n") / F.col("total")).alias("a"), F.lit(None).cast("double").alias("b"))
    return back.unionByName(onward).groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b"))


class Looked:
    """Values by 64-bit keys; zero for keys that are not there. Keys are sorted, and their first bits say where to look."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        keys, first = np.unique(keys, return_index=True)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = (np.cumsum(counts) - counts).astype(np.int32)
        self.count, self.keys = len(keys), np.append(keys, ~np.uint64(0))
        self.values = [np.append(v[first], v.dtype.type(0)) for v in values]

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        at = self.starts[keys >> self.shift]
        on = np.nonzero(self.keys[at] < keys)[0]
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < keys[on]]
        at[self.keys[at] != keys] = self.count
        return [v[at] for v in self.values]


class SuffixTree:
    """The part of the model that a block of texts meets."""

    def __init__(self, words: Looked, tree: Looked, n_tokens: int, n_words: int, depth: int):
        self.words, self.tree, self.total, self.depth = words, tree, n_tokens + n_words + 1, depth

    def scores(self, hashes: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its training count and the log10 probabilities by its count and by its longest state."""
        c = self.words(hashes)[0]
        base = (c + 1) / self.total
        p = base.copy()
        at = np.nonzero(inner)[0]
        states = hashes[at]
        for k in range(1, self.depth + 1):
            if k > 1:
                # A state stands in front of what its suffix, a state too, begins with.
                at = at[at > 0] - 1
                at = at[inner[at]]
                states = reduce(chained, [hashes[at + j] for j in range(k)])
            back = self.tree(states)[1]
            kept = back > 0
            at, back, states = at[kept], back[kept], states[kept]
            p[at + k] = self.tree(chained(states, hashes[at + k]))[0] + back * p[at + k]
        return c, np.log10(base), np.log10(p)


ANSWERS = "block long, keys binary, c binary, a binary, b binary"


def _answers(asked: DataFrame, tree: DataFrame, part_bits: int) -> DataFrame:
    """``ANSWERS`` rows: what the tree says of the keys that each block asks for (``part, block, keys``)."""
    schema = _arrow(ANSWERS)
    part = F.shiftrightunsigned("key", 64 - part_bits).cast("int") if part_bits else F.lit(0)
    null = F.lit(None)
    sides = [
        tree.select(part.alias("part"), F.lit(0).alias("side"), "key", "a", "b", null.cast("long").alias("block"), null.cast("binary").alias("keys")),
        asked.select("part", F.lit(1).alias("side"), null.cast("long").alias("key"), null.cast("double").alias("a"), null.cast("double").alias("b"), "block", "keys"),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, told = None, [], None
        for number, rows in _by_number(batches, "part"):
            if number != now:
                now, held, told = number, [], None
            is_tree = rows["side"].to_numpy() == 0
            if is_tree.any():
                held.append(rows.slice(0, int(is_tree.sum())))
            for row in rows.slice(int(is_tree.sum())).select(["block", "keys"]).to_pylist():
                if told is None and held:
                    whole = pa.Table.from_batches(held)
                    key, a, b = whole["key"].to_numpy().view(np.uint64), *(whole[name].fill_null(0.0).to_numpy() for name in ("a", "b"))
                    order = np.argsort(key)
                    told, held = [x[order] for x in (key, a, b)], []
                if told is None:
                    continue
                keys = np.frombuffer(row["keys"], np.uint64)
                at = np.minimum(np.searchsorted(told[0], keys), len(told[0]) - 1)
                found = told[0][at] == keys
                at = at[found]
                if len(at):
                    yield _batch(schema, [{"block": row["block"], "keys": keys[found].tobytes(), "a": told[1][at].tobytes(), "b": told[2][at].tobytes()}])

    return _dealt(sides[0].unionAll(sides[1]), "part", 1 << part_bits, "side").mapInArrow(run, ANSWERS)


def score_language(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2,
    depth: int = 3, min_next: int = 8, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words between blanks and one end for each text. The model learns from
    all rows whose crc32 of the id modulo ``folds`` is not ``held_out_fold``. Its root is
    the add-one word distribution of ``base_score``; below it stand contexts of up to
    ``depth`` words (see ``learn_tree``), with next tokens seen ``min_next`` times or more
    after them. A token is scored by the longest retained suffix of what stands before it.
    Words and contexts are known by 64-bit hashes.

    The model stays a table. Texts are dealt to blocks of at most about ``block_bytes``, as many
    for each core; each block names its distinct words and frequent sequences with their counts, gets back
    their totals over all blocks and what the tree says of them, and is scored with that.

    Null and empty texts have the end token alone; texts of any length are taken whole.
    Rows without an id are learned from and not held out. Repeated rows count and
    return as often. Without any training row, a token has probability 1 / 1. Other columns are
    ignored; an empty table gives no rows. Learns while the plan is built.
    """
    held_out = F.coalesce(fold(F.col(id_col), folds) == held_out_fold, F.lit(False))
    rows = documents.select(
        F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    training, context = rows.filter(~F.col("held_out")).select("text"), rows.sparkSession.sparkContext
    bytes_of = F.octet_length("text")
    sizes = rows.agg(F.sum(bytes_of).alias("all"), F.sum(F.when(~F.col("held_out"), bytes_of)).alias("learned")).first()
    size, learned = sizes["all"] or 0, sizes["learned"] or 0
    training, bits = long_tasks(training, learned), table_bits(learned)
    tables = [context.broadcast(frequent_grams(training, _grams_of(depth), min_next, bits).packed)]
    tables.append(context.broadcast(frequent_grams(training, _grams_of(depth, tables[0], bits), min_next, bits).packed))

    cores = context.defaultParallelism
    count = max(1, -(-size // block_bytes), min(cores, size // LEAST_BYTES))
    if count > cores and block_bytes >= LEAST_BYTES:
        count = -(-count // cores) * cores
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count))
    blocks, part_bits = rows.withColumn("block", block), (size // PART_BYTES).bit_length()
    counted = _counted(_dealt(blocks, "block", count), tables, bits, depth, part_bits)
    met = stored(_merged_parts(counted, min_next, part_bits), "tree-met")
    counts = met.filter(F.col("kind") == ROW).select("k", "gram", "prefix", "suffix", "n")
    total = met.filter(F.col("kind") == TOTAL).agg(F.sum("n").alias("n"), F.sum("gram").alias("v")).first()
    n_tokens, n_words = total["n"] or 0, total["v"] or 0

    tree = learn_tree(counts, n_tokens, depth)
    null = F.lit(None).cast("binary")
    by_words = met.filter(F.col("kind") == WORDS).select("block", "keys", "c", null.alias("a"), null.alias("b"))
    by_tree = _answers(met.filter(F.col("kind") == ASKED).select("part", "block", "keys"), tree, part_bits)

    kind, answer_schema = dict(rows.dtypes)["doc_id"], pa.schema([(name, pa.binary()) for name in ("keys", "c", "a", "b")])
    out = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def model(answers: list[pa.RecordBatch]) -> SuffixTree:
        told = pa.Table.from_batches(answers, schema=answer_schema)
        words = pc.is_valid(told["c"])

        def gathered(rows: pa.Table, **kinds) -> list[np.ndarray]:
            return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in rows[name])]) for name, kind in kinds.items()]

        by_word = Looked(*gathered(told.filter(words), keys=np.uint64, c=np.int64))
        by_tree = Looked(*gathered(told.filter(pc.invert(words)), keys=np.uint64, a=np.float64, b=np.float64))
        return SuffixTree(by_word, by_tree, n_tokens, n_words, depth)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, tree = None, [], None
        for number, rows in _by_number(batches, "block"):
            if number != now:
                now, answers, tree = number, [], None
            told = int((rows["side"].to_numpy() == 0).sum())
            answers.append(rows.slice(0, told).select(answer_schema.names))
            texts = rows.slice(told)
            if not texts.num_rows:
                continue
            if tree is None:
                tree, answers = model(answers), []
            at = 0
            for hashes, inner, lengths in _streams(texts):
                c, base, logs = tree.scores(hashes, inner)
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), base, logs)]
                part = texts.slice(at, len(lengths))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(lengths), *map(pa.array, sums)], schema=out)
                at += len(lengths)

    answers = by_words.unionByName(by_tree).select(
        "block", F.lit(0).alias("side"), "keys", "c", "a", "b", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text")
    )
    texts = blocks.select("block", F.lit(1).alias("side"), *[null.alias(name) for name in ("keys", "c", "a", "b")], "doc_id", "held_out", "text")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = _dealt(answers.unionAll(texts), "block", count, "side").mapInArrow(score, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
