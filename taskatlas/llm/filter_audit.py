"""How filters act in every order: what each step keeps, removes and repeats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskatlas.llm.words import LOWER, UPPER

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions on one text (null: empty); words are parts between blanks, as written."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _cells(documents: DataFrame, labels: DataFrame, failures: Mapping[str, Column], copy_bit: int, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters that they fail.

    Bit i of the mask is the i-th filter; ``copy_bit`` is that of texts which a row
    with a smaller id has too. Rows are counted by (id, text digest, part) and then by
    text before any two of them are compared, so copies meet as counts.
    """
    bits = sum((F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(failures.values())), F.lit(0))
    rows = documents.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("digest"),
        bits.alias("mask"),
    )
    counted = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    marked = counted.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    # The least id of a group with its own count; a row without an id is no one's copy.
    known = F.col("id").isNotNull()
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic", known.alias("known")).agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least")
    )
    least_of_text = F.min(F.when(F.col("known"), F.col("least.id"))).over(Window.partitionBy("digest"))
    split = groups.withColumn("first", F.when(~F.col("known"), F.col("n")).when(F.col("least.id") == least_of_text, F.col("least.n")).otherwise(F.lit(0)))
    both = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + F.lit(1 << copy_bit)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    ))
    by_mask = split.select("part", "good", "toxic", both.alias("c")).select("part", "good", "toxic", "c.*")
    return by_mask.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _folded(orders: Column, powers: Column) -> Column:
    """One struct of counts per order and step for a cell ``mask, n, good, toxic``, in the order of ``orders``."""
    none = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")

    def weighted(condition: Column, amount: str = "n") -> Column:
        return F.when(condition, F.col(amount)).otherwise(F.lit(0).cast("long"))

    def step(state: Column, which: Column) -> Column:
        there, power = state["there"], F.get(powers, which)
        fails = F.col("mask").bitwiseAND(power) != 0
        entry = F.struct(
            weighted(there & ~fails).alias("kept"),
            weighted(there & fails).alias("removed"),
            weighted(fails & ~there).alias("redundant"),
            weighted(F.col("mask") == power).alias("unique_fails"),
            weighted(there & fails, "good").alias("good_lost"),
            weighted(there & fails, "toxic").alias("toxic_lost"),
        )
        return F.struct((there & ~fails).alias("there"), F.concat(state["steps"], F.array(entry)).alias("steps"))

    start = F.struct(F.lit(True).alias("there"), none.alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def _added(x: Column, y: Column) -> Column:
    return F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])


def audit_filters(
    documents: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, *, copy_filter: str = "E",
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """Per part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``.

    ``failures`` maps one-letter names to conditions on a row (default: ``text_failures``);
    ``copy_filter`` is one more, failed by a text that a row with a smaller id has too. All
    documents of a part fall into at most 2 ** filters cells. Each cell folds its mask
    through every order with ``aggregate`` inside ``transform``; the weighted structs of a
    part's cells are added place by place. ``shapley`` is the number that the step's filter
    removes in all orders together, at any step.

    Null and empty texts count as empty texts and are copies of each other; a null part is
    the empty string. Rows that share an id and a text are not copies of each other; a row
    without an id is no copy and makes none. An id with several labels is good or toxic if
    one of them says so; missing labels are neither. Equal counts need no order. Other columns,
    also of clashing names, are ignored; an empty table gives no rows.
    """
    failures = dict(failures if failures is not None else text_failures(F.col(text_col)))
    names = [*failures, copy_filter]
    cells = _cells(documents, labels, failures, len(failures), id_col, text_col, part_col)
    orders = list(permutations(range(len(names))))
    numbers = F.array(*[F.array(*[F.lit(i) for i in order]) for order in orders])
    spellings = F.array(*[F.lit("".join(names[i] for i in order)) for order in orders])
    powers = F.array(*[F.lit(1 << i) for i in range(len(names))])
    folded = cells.select("part", _folded(numbers, powers).alias("counts"))
    # A part has at most 2 ** filters cells, so its list is bounded.
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(orders) * len(names))
    merged = folded.groupBy("part").agg(F.collect_list("counts").alias("cells")).select(
        "part", F.aggregate("cells", zero, lambda total, cell: F.zip_with(total, cell, _added)).alias("counts")
    )
    placed = merged.select("part", F.posexplode("counts").alias("place", "c")).select(
        "part", F.get(spellings, F.floor(F.col("place") / len(names)).cast("int")).alias("filter_order"), (F.col("place") % len(names) + 1).alias("step"), "c.*"
    )
    all_orders = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return placed.withColumn("shapley", F.sum("removed").over(all_orders))
