"""Phrase collocations: counts of longest windows, marginalised to all shorter phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.llm.word_grams import GramTable, Vocabulary, chained, frequent_grams, long_tasks, merged_rows, table_bits, text_bytes, text_runs
from taskatlas.operators.ranking import top_per_group
from taskatlas.sources.storage import stored

# Small letters; all that ends a piece becomes a full stop.
PIECE_TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
HELD_ROWS = 1_000_000
HELD_WORDS = 300_000


def piece_words(texts: list[str | None]) -> list[bytes]:
    """Words of all texts in order, with a full stop wherever a piece or text ends."""
    data = b".".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"."
    return data.translate(PIECE_TABLE).replace(b".", b" . ").split()


def _streams(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Per language of a batch: word numbers (0: a piece ends) and the hashes of the words in that language."""
    vocabulary[b"."]
    for part in text_runs(batch):
        by_lang: dict[str, list[str | None]] = {}
        for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            numbers = vocabulary.numbers(piece_words(texts))
            own = Vocabulary()
            own[lang.encode()]
            yield lang, numbers, chained(np.broadcast_to(own.hashes(), len(numbers)), vocabulary.hashes()[numbers])


Knows = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def _beginnings(numbers: np.ndarray, hashes: np.ndarray, longest: int, knows: Knows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 1 .. ``longest``: k, the places where k words follow inside a piece, and the hashes of those words.

    ``knows(k, hashes of k words, places of their last word)`` says which of them may grow.
    """
    at = np.nonzero(numbers > 0)[0]
    grams = hashes[at]
    yield 1, at, grams
    for k in range(1, longest):
        known = knows(k, grams, at + k - 1)
        at, grams = at[known], grams[known]
        room = at + k < len(numbers)
        room[room] = numbers[at[room] + k] > 0
        at = at[room]
        grams = chained(grams[room], hashes[at + k])
        yield k + 1, at, grams


def _counted_grams(orders: range, knows_of: Callable[[], Callable[[np.ndarray], Knows]]):
    """For ``frequent_grams``: hashes of the phrases of these numbers of words."""

    def grams_of():
        vocabulary, knows_in = Vocabulary(), knows_of()

        def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            vocabulary.bound(HELD_WORDS)
            for _, numbers, hashes in _streams(batch, vocabulary):
                for k, _, grams in _beginnings(numbers, hashes, orders.stop - 1, knows_in(hashes)):
                    if k in orders:
                        yield grams

        return read

    return grams_of


def _all_known(hashes: np.ndarray) -> Knows:
    return lambda k, grams, last: np.ones(len(grams), dtype=bool)


def _chain_of(packed, bits: int) -> Callable[[], Callable[[np.ndarray], Knows]]:
    """Phrases may grow while their words and pairs of neighbours are frequent."""

    def start():
        table = GramTable(packed.value, bits)

        def knows_in(hashes: np.ndarray) -> Knows:
            def knows(k: int, grams: np.ndarray, last: np.ndarray) -> np.ndarray:
                return table.frequent(grams if k < 3 else chained(hashes[last - 1], hashes[last]))

            return knows

        return knows_in

    return start


def frequent_phrases(rows: DataFrame, longest: int, min_count: int, bits: int) -> tuple[GramTable, GramTable]:
    """Tables of frequent words and pairs, and of longer phrases of frequent pairs."""
    short = frequent_grams(rows, _counted_grams(range(1, 3), lambda: _all_known), min_count, bits)
    packed = rows.sparkSession.sparkContext.broadcast(short.packed)
    return short, frequent_grams(rows, _counted_grams(range(3, longest + 1), _chain_of(packed, bits)), min_count, bits)


def window_counts(rows: DataFrame, tables: tuple[GramTable, GramTable], longest: int) -> DataFrame:
    """``lang, w1 .. wn, n``: counts of the longest windows, one starting at every word.

    A window ends with its piece, after ``longest`` words, or before the word with which
    ``tables`` no longer know it as frequent; the columns beyond are empty, all of them
    where the first word is rare. Counts are partial: a window may come several times.
    """
    shared, bits = rows.sparkSession.sparkContext.broadcast([t.packed for t in tables]), [t.bits for t in tables]
    names = ["lang", *[f"w{i + 1}" for i in range(longest)], "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = map(GramTable, shared.value, bits)
        # Windows hold few of the words; those have numbers of their own, as long as windows are held.
        vocabulary, langs, kept = Vocabulary(), Vocabulary(), Vocabulary()
        held: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []

        def knows(k: int, grams: np.ndarray, last: np.ndarray) -> np.ndarray:
            return (short if k < 3 else long).frequent(grams)

        def key_of(columns: list[np.ndarray]) -> np.ndarray:
            key = columns[0].astype(np.uint64)
            for c in columns[1:]:
                key = chained(key, c.astype(np.uint64))
            return key

        def merge(parts):
            columns = [np.concatenate(c) for c in zip(*[p[0] for p in parts])]
            return merged_rows(columns, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))

        def keep(words: list[np.ndarray]) -> list[np.ndarray]:
            kept[b"."]
            used, at = np.unique(np.stack(words), return_inverse=True)
            return list(kept.numbers([vocabulary.words[i] for i in used.tolist()])[at.reshape(len(words), -1)])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                (lang, *words), counts = merge(held)
                held.clear()
                # Number 0 is the end of a piece and stands for an empty column.
                spelt = pa.array([b"", *kept.words[1:]], pa.binary()).cast(pa.string())
                kept.bound(0)
                spoken = pa.array(langs.words, pa.binary()).cast(pa.string())
                for at in range(0, len(counts), 50_000):
                    cut = slice(at, at + 50_000)
                    columns = [spoken.take(pa.array(lang[cut])), *[spelt.take(pa.array(w[cut])) for w in words]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[cut])], names=names)

        for batch in batches:
            for lang, numbers, hashes in _streams(batch, vocabulary):
                columns = [np.full(len(numbers), langs[lang.encode()], np.int32), *[np.zeros_like(numbers) for _ in range(longest)]]
                for k, at, grams in _beginnings(numbers, hashes, longest, knows):
                    at = at[knows(k, grams, at)]
                    columns[k][at] = numbers[at + k - 1]
                starts = numbers > 0
                columns = [c[starts] for c in columns]
                (lang_column, *words), counts = merge([(columns, np.ones(len(columns[0]), np.int64), key_of(columns))])
                columns = [lang_column, *keep(words)]
                held.append((columns, counts, key_of(columns)))
            vocabulary.bound(HELD_WORDS)
            if sum(len(p[1]) for p in held) > HELD_ROWS:
                columns, counts = merge(held)
                held[:] = [(columns, counts, key_of(columns))]
                if len(counts) > HELD_ROWS // 2:
                    yield from flush()
        yield from flush()

    schema = ", ".join([*[f"{n} string" for n in names[:-1]], "n long"])
    return rows.mapInArrow(run, schema)


def phrase_counts(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100) -> DataFrame:
    """``lang, words, f``: all phrases of up to ``longest`` words that occur ``min_count`` times or more, in every language.

    A row with no words has the number of all word occurrences of its language. Only the
    padded longest windows are counted; ROLLUP adds them up for their shorter
    beginnings. Windows stop early only where their beginning is too rare for any frequent
    phrase to start with it, so every frequent phrase is counted in full.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text")).filter(F.length("text") > 0)
    size = text_bytes(rows)
    rows = long_tasks(rows, size)
    tables = frequent_phrases(rows, longest, min_count, table_bits(size))
    parts = [f"w{i + 1}" for i in range(longest)]
    counted = window_counts(rows, tables, longest).groupBy("lang", *parts).agg(F.sum("n").alias("n"))
    sums = counted.rollup("lang", *parts).agg(F.sum("n").alias("f"), F.grouping_id().alias("without"))
    size = F.lit(longest) - F.bit_count("without")
    words = F.slice(F.array(*parts), 1, F.greatest(size, F.lit(0)))
    # Beginnings that reach into the padding are no phrases; the grand total over all languages goes.
    real = (size == 0) | ((size > 0) & (F.get(F.array(*parts), size - 1) != "") & (F.col("f") >= min_count))
    return sums.filter(real).select("lang", words.alias("words"), "f")


def mine_collocations(
    documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, top: int = 2000,
) -> DataFrame:
    """Per language the ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``longest`` words with ``a`` >= ``min_count`` occurrences is scored at
    its weakest cut: floor(1000 * a * n / (l * r)), with ``l`` and ``r`` the counts of
    the two parts and ``n`` all words of the language. Of equal cuts the first one counts.
    Phrases that stand inside a longer one with as many occurrences go.

    Null and empty texts have no words; a null language is ``und``. Texts of any length are
    taken whole; rows that repeat count again. Equal scores are ranked by occurrences,
    then by the bytes of the phrase. Other columns are ignored; an empty table
    gives no rows. Counts twice while the plan is built.
    """
    counts = stored(
        phrase_counts(documents, text_col=text_col, lang_col=lang_col, longest=longest, min_count=min_count)
        .select("lang", "words", F.array_join("words", " ").alias("phrase"), "f"),
        "phrase-counts",
    )
    known = counts.filter(F.size("words") > 0).select("lang", "phrase", "f")
    totals = counts.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    phrases = counts.filter(F.size("words") > 1).select("lang", "words", "phrase", F.col("f").alias("a"))

    size = F.size("words")
    cuts = phrases.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("right"),
    )
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    whole = "cast({} as decimal(20, 0))".format
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Whatever is as frequent as a longer phrase around it is also as frequent as one with a single word more.
    inner = phrases.filter(size > 2).select(
        "lang", "a", F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1))).alias("inner")
    )
    around = inner.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    result = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = top_per_group(result, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top, rank="rank")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
