"""Benchmark windows in training documents: found, verified, counted and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskatlas.llm.words import words
from taskatlas.sources.storage import stored

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PROBES = 4  # words of a window that are hashed to find candidates
BITS_PER_WINDOW = 64
BROADCAST_WINDOWS = 500_000  # a benchmark of at most so many windows is broadcast to the scan; a larger one is joined by shuffles


def window_texts(tokens: Column, width: int) -> Column:
    """All windows of ``width`` words; a shorter, not empty list is one window."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(width)), " ")))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int = 10) -> DataFrame:
    """``window, size, items``: each different window with the ids of its items."""
    rows = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("tokens"))
    each = rows.filter(F.size("tokens") > 0).select("item", F.explode(window_texts(F.col("tokens"), width)).alias("window"))
    sized = each.withColumn("size", F.size(F.split("window", " ")))
    return sized.groupBy("window", "size").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))


def _probe(tokens: Column, start: Column, size: int) -> Column:
    """Hash of the words at a few places of the window of ``size`` words at ``start``, from 0."""
    places = sorted({(size - 1) * i // (PROBES - 1) for i in range(PROBES)})
    return F.xxhash64(F.lit(size), *[F.get(tokens, start + p) for p in places])


def _filters(windows: DataFrame, counts: dict[int, int]) -> dict[int, tuple[int, Column]]:
    """Per window size the bits of its windows' hashes, as a table of longs.

    64 bits for each window of a benchmark whose size was checked, so about one
    window in 64 of the training words is a chance candidate.
    """
    split = windows.select("size", F.split("window", " ").alias("tokens"))
    found = {}
    for size, n in counts.items():
        longs = 1 << max(4, (n * BITS_PER_WINDOW // 64 - 1).bit_length())
        hashed = _probe(F.col("tokens"), F.lit(0), size)
        bit = F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(longs - 1)).alias("at")
        mask = F.expr("shiftleft(1L, CAST(h & 63 AS INT))")
        cells = split.filter(F.col("size") == size).select(hashed.alias("h"), bit).groupBy("at").agg(F.bit_or(mask).alias("bits"))
        table = [0] * longs
        for cell in cells.collect():
            table[cell["at"]] = cell["bits"]
        found[size] = longs, F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    return found


def _candidates(size: int, filled: tuple[int, Column] | None) -> Column:
    """First word and text of the windows of ``tokens`` that the bit table lets pass; all without a table."""
    last = F.size("tokens") - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def likely(i):
        longs, table = filled
        h = _probe(F.col("tokens"), i, size)
        cell = F.get(table, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(longs - 1)).cast("int"))
        return F.getbit(cell, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def shown(i):
        return F.struct(i.alias("first"), F.array_join(F.slice("tokens", i + 1, F.lit(size)), " ").alias("window"))

    return F.transform(F.filter(starts, likely) if filled else starts, shown)


def hit_windows(documents: DataFrame, id_col: str, text_col: str, windows: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, key, n_words, spans, items``.

    ``spans`` are the merged word ranges ``(first, last)`` of benchmark windows,
    ``items`` the sorted ids with a window in the text. A bit table picks candidate
    windows inside each row; their words are then compared in a join, so a hit is
    never a mere hash. Repeated rows give repeated results.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), words(F.col(text_col)).alias("tokens"))
    windows = stored(windows, "benchmark-windows")
    # At most ``width`` different sizes.
    counts = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    small = sum(counts.values()) <= BROADCAST_WINDOWS
    tables = _filters(windows, counts) if small else dict.fromkeys(counts)
    candidates = [_candidates(size, filled) for size, filled in sorted(tables.items())]
    # Without candidates one row keeps the document.
    listed = F.concat(*candidates) if candidates else F.array().cast("array<struct<first:int,window:string>>")
    spread = rows.select("doc_id", "key", F.size("tokens").alias("n_words"), F.posexplode_outer(listed).alias("nth", "place"))
    spread = spread.select("doc_id", "key", "n_words", "nth", F.col("place.first").alias("first"), F.col("place.window").alias("window"))
    joined = spread.join(F.broadcast(windows) if small else windows, "window", "left")
    hit = F.when(F.col("size").isNotNull(), F.struct("first", (F.col("first") + F.col("size") - 1).alias("last")))
    grouped = joined.groupBy("doc_id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("copies"),
    )
    merged = F.aggregate(
        "found",
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"] - 1),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.named_struct(F.lit("first"), F.element_at(done, -1)["first"], F.lit("last"), F.greatest(F.element_at(done, -1)["last"], x["last"]))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return grouped.select(
        "doc_id", "key", "n_words", merged.alias("spans"), "items", F.explode(F.expr("sequence(1L, copies)")).alias("copy")
    ).drop("copy")


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items, spans, contaminated``.

    A null or empty text has no words and is clean, a benchmark without words
    marks nothing, an empty table gives no rows; other columns are ignored. Runs
    jobs on the benchmark while the plan is built.
    """
    rows = hit_windows(documents, id_col, text_col, benchmark_windows(benchmark, item_col, item_text, width))
    words_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return rows.select(
        "doc_id", "n_words", words_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and the separators that follow them."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    between = F.split(text, WORD)
    kept = F.transform(
        found, lambda w, i: F.when(F.exists(spans, lambda s: i.between(s["first"], s["last"])), F.lit("")).otherwise(F.concat(w, F.get(between, i + 1)))
    )
    return F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them in any case."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """The documents with all their columns, without hit documents or without hit words.

    ``remove`` is documents or spans. Clean rows stay as they are, also those with
    a null id or text and repeated rows; rows of one id are judged by their own texts.
    Empty texts and empty tables have nothing to hit, very long texts are read whole.
    Columns may have any names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    rows = hit_windows(documents, id_col, text_col, benchmark_windows(benchmark, item_col, item_text, width))
    row_id, key, spans = free_names(documents, "__id", "__key", "__spans")
    hits = rows.filter(F.size("spans") > 0).select(F.col("doc_id").alias(row_id), F.col("key").alias(key), F.col("spans").alias(spans))
    hits = hits.dropDuplicates([row_id, key])
    same = documents[id_col].eqNullSafe(F.col(row_id)) & (F.xxhash64(documents[text_col]) == F.col(key))
    if remove == "documents":
        return documents.join(hits, same, "left_anti")
    cleaned = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(without_spans(F.col(text_col), F.col(spans)))
    return documents.join(hits, same, "left").withColumn(text_col, cleaned).drop(row_id, key, spans)
