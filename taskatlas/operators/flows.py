"""Flow graph category -> task -> occupation, from match counts of importance ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskatlas.functions.text import category_title, shorten
from taskatlas.operators.joins import add_totals, spread_join
from taskatlas.operators.ranking import top_per_group

MIN_LINK = 0.01
LABEL_WIDTH = 60
# Sums are rounded before they decide a rank, so the order of addition cannot.
RANK_DIGITS = 9


def contributions(counts: DataFrame) -> DataFrame:
    """Add ``contribution``: the task's share of its occupation's matches times importance.

    Totals are per category, year and occupation code; a total of 0 gives 0.
    """
    totalled = add_totals(counts, ["ai_category", "year", "soc_code"], [F.sum("matches").alias("occupation_matches")])
    share = F.coalesce(F.try_divide(F.col("matches"), F.col("occupation_matches")), F.lit(0.0))
    return totalled.withColumns({"task_weight": share, "contribution": share * F.col("data_value")})


def top_occupations(counts: DataFrame, first_year: int, n: int) -> DataFrame:
    """Occupations with the largest contribution over all categories in the first year.

    Rows are reduced to one per occupation and category before the shares are
    taken, so no row-level join is needed.
    """
    reduced = counts.filter(F.col("year") == first_year).groupBy("ai_category", "soc_code", "title").agg(
        F.sum(F.col("matches") * F.col("data_value")).alias("weighted"), F.sum("matches").alias("m")
    )
    totalled = add_totals(reduced, ["ai_category", "soc_code"], [F.sum("m").alias("total")])
    share = F.coalesce(F.try_divide(F.col("weighted"), F.col("total")), F.lit(0.0))
    total = totalled.groupBy("soc_code", "title").agg(F.round(F.sum(share), RANK_DIGITS).alias("total_contribution"))
    return total.orderBy(F.col("total_contribution").desc(), "soc_code", "title").limit(n)


def top_tasks(counts: DataFrame, occupations: DataFrame, first_year: int, m: int) -> DataFrame:
    """The ``m`` largest tasks per category among the given occupations in the first year."""
    kept = counts.filter(F.col("year") == first_year).join(occupations.select("soc_code"), "soc_code", "left_semi")
    sums = contributions(kept).groupBy("ai_category", "task").agg(
        F.round(F.sum("contribution"), RANK_DIGITS).alias("total_contribution")
    )
    order = [F.col("total_contribution").desc(), F.col("task").asc()]
    return top_per_group(sums, ["ai_category"], order, m, rank="task_rank")


def flow_links(
    counts: DataFrame, occupations: DataFrame, tasks: DataFrame, *, min_link: float = MIN_LINK, min_contribution: float | None = None
) -> DataFrame:
    """Links per year: ``(year, kind, ai_category, task, soc_code, value)``.

    Shares are taken again over the kept rows. A category -> task link is the sum
    over occupations; a task -> occupation link is one rating row, present only
    with its parent link.
    """
    kept = counts.join(occupations.select("soc_code"), "soc_code", "left_semi")
    kept = spread_join(kept, tasks.select("ai_category", "task"), ["ai_category", "task"], "left_semi")
    rows = contributions(kept)
    if min_contribution is not None:
        rows = rows.filter(F.col("contribution") > min_contribution)
    parents = rows.groupBy("year", "ai_category", "task").agg(F.sum("contribution").alias("value"))
    parents = parents.filter(F.round("value", RANK_DIGITS) > min_link)
    to_task = parents.select(
        "year", F.lit("category_task").alias("kind"), "ai_category", "task", F.lit(None).cast("string").alias("soc_code"), "value"
    )
    leaves = rows.filter(F.round("contribution", RANK_DIGITS) > min_link).join(
        parents.select("year", "ai_category", "task"), ["year", "ai_category", "task"], "left_semi"
    )
    to_occupation = leaves.select(
        "year", F.lit("task_occupation").alias("kind"), "ai_category", "task", "soc_code", F.col("contribution").alias("value")
    )
    return to_task.unionByName(to_occupation)


def flow_nodes(counts: DataFrame, occupations: DataFrame, tasks: DataFrame) -> DataFrame:
    """Node table: categories, then tasks by category, then occupations, numbered from 0.

    Tasks are numbered inside their category and shifted by what stands before it. Windows
    over one group hold one row per category, or the ``n`` rows of ``top_occupations``.
    """
    none, one = F.lit(None).cast("string"), Window.partitionBy(F.lit(0))
    by_category = one.orderBy(F.col("ai_category").asc_nulls_first())
    categories = counts.select("ai_category").distinct()
    n_categories = categories.agg(F.count("*")).scalar()
    n_tasks = tasks.agg(F.count("*")).scalar()
    category_nodes = categories.select(
        F.row_number().over(by_category).alias("number"), F.lit("category").alias("kind"), "ai_category", none.alias("task"),
        none.alias("soc_code"), category_title(F.col("ai_category")).alias("label"),
    )
    sizes = tasks.groupBy("ai_category").agg(F.count("*").alias("n"))
    before = F.sum("n").over(by_category.rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("ai_category").alias("of"), F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("ai_category").orderBy(F.col("task_rank").cast("double"), "task"))
    numbered = tasks.withColumn("inside", inside).join(starts, F.col("ai_category").eqNullSafe(F.col("of")))
    task_nodes = numbered.select(
        (n_categories + F.col("start") + F.col("inside")).alias("number"), F.lit("task").alias("kind"), "ai_category", "task",
        none.alias("soc_code"), shorten(F.col("task"), LABEL_WIDTH).alias("label"),
    )
    by_weight = F.row_number().over(one.orderBy(-F.col("total_contribution"), "soc_code", "title"))
    occupation_nodes = occupations.select(
        (n_categories + n_tasks + by_weight).alias("number"), F.lit("occupation").alias("kind"), none.alias("ai_category"),
        none.alias("task"), "soc_code", F.col("title").alias("label"),
    )
    nodes = category_nodes.unionByName(task_nodes).unionByName(occupation_nodes)
    return nodes.select((F.col("number") - 1).cast("int").alias("node_id"), "kind", "ai_category", "task", "soc_code", "label")
