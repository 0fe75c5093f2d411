"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.sources.storage import stored


def _stars(edges: DataFrame) -> bool:
    """Whether each node with a smaller neighbour has just one, and that one none; here u > v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than a node move to its smallest neighbour; at most a row for each edge, so repeats wait for the small star."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours smaller than a node, and the node, move to the smallest one; here u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # An edge gives its neighbour's row and, once more, that of the node itself.
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return edges.join(least, "u").select(F.inline(ends)).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node with an edge to another.

    ``edges`` has two columns of ids; loops, nulls and repeats do no harm. Large and
    small stars alternate until only stars are left, which takes about log rounds; a
    round is stored, so lost executors cost at most that round. Runs jobs while the
    plan is built.
    """
    a, b = edges.columns
    started = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = stored(started, "components")
    while not _stars(now):
        now = stored(_small_star(_large_star(now)), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
