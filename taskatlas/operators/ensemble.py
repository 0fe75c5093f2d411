"""Several models' labels: joining, voting, agreement."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskatlas.functions.voting import MEAN_DIGITS, vote
from taskatlas.operators.columns import first_present
from taskatlas.operators.filters import low_confidence
from taskatlas.operators.joins import update_merge

# Column names accepted for a label and its confidence.
CATEGORY_NAMES = ("ai_category", "category", "predicted_category")
CONFIDENCE_NAMES = ("ai_category_confidence", "confidence")


def model_rows(
    df: DataFrame,
    pos: int,
    name: str,
    id_col: str,
    category_col: str = "ai_category",
    confidence_col: str = "ai_category_confidence",
    weight: int = 1,
) -> DataFrame:
    """One model's output as long rows; column names are found through their aliases."""
    if id_col not in df.columns:
        raise ValueError(f"id column {id_col!r} not found, available: {df.columns}")
    category = first_present(df, (category_col, *CATEGORY_NAMES))
    if category is None:
        raise ValueError(f"category column not found, available: {df.columns}")
    confidence = first_present(df, (confidence_col, *CONFIDENCE_NAMES))
    return df.select(
        F.col(id_col).alias("id"),
        F.lit(pos).alias("model_pos"),
        F.lit(name).alias("model"),
        F.col(category).cast("string").alias("category"),
        (F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")).alias("confidence"),
        F.lit(weight).alias("weight"),
    )


def combine_models(inputs: Sequence[DataFrame], names: Sequence[str] | None, id_col: str, **columns) -> DataFrame:
    """Long predictions of the ids that every input has.

    The inputs are stacked and counted once per id in place of a chain of joins.
    Rows with a null id are dropped.
    """
    if len(inputs) < 2:
        raise ValueError("at least two inputs are needed")
    if len(inputs) > 62:
        raise ValueError("at most 62 inputs can be combined")
    names = list(names or [])
    names += [f"model_{i + 1}" for i in range(len(names), len(inputs))]
    rows = None
    for pos, (df, name) in enumerate(zip(inputs, names)):
        # One bit per model: the set of models of an id fits in a number and combines early.
        part = model_rows(df, pos, name, id_col, **columns).withColumn("__bit", F.lit(1 << pos).cast("long"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.filter(F.col("id").isNotNull())
    full = rows.groupBy("id").agg(F.bit_or("__bit").alias("seen")).filter(F.col("seen") == (1 << len(inputs)) - 1)
    return rows.drop("__bit").join(full.select("id"), "id", "left_semi")


def with_base(voted: DataFrame, base: DataFrame, id_col: str) -> DataFrame:
    """Vote results (or wide models) with the base input's columns that they do not have."""
    shared = [c for c in base.columns if c != id_col and c in voted.columns]
    return voted.join(base.drop(*shared).withColumnRenamed(id_col, "id"), "id")


def wide_models(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """``{model}_category`` and ``{model}_confidence`` columns, one row per id."""
    return long.groupBy("id").pivot("model", list(names)).agg(
        F.first("category").alias("category"), F.first("confidence").alias("confidence")
    )


def predictions_long(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.select(id_col, F.inline("predictions"))


def pick_models(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep a subset of stored predictions."""
    return df.withColumn("predictions", F.filter("predictions", lambda p: p["model"].isin(*names)))


def vote_rows(df: DataFrame, prefix: str = "ensemble", *, weighted: bool = False) -> DataFrame:
    """Vote inside each row over the array ``predictions``."""
    best = vote(F.col("predictions"), weighted=weighted)
    return df.withColumn("__vote", best).select(
        *df.columns,
        F.col("__vote.category").alias(f"{prefix}_category"),
        F.col("__vote.confidence").alias(f"{prefix}_confidence"),
        F.col("__vote.votes").alias(f"{prefix}_votes"),
    )


def vote_long(long: DataFrame, id_col: str = "id", prefix: str = "ensemble", *, weighted: bool = False) -> DataFrame:
    """Vote over long rows; ids without a usable prediction give null, null, 0.

    Two hash aggregates with partial sums; no group is collected.
    """
    usable = F.col("category").isNotNull() & F.col("confidence").isNotNull()
    weight = (F.col("weight") if weighted else F.lit(1)).cast("long")
    tally = long.groupBy(id_col, F.when(usable, F.col("category")).alias("category")).agg(
        F.sum(F.when(usable, weight).otherwise(F.lit(0))).alias("votes"),
        F.sum(F.when(usable, F.col("confidence") * weight)).alias("total"),
        F.min("model_pos").alias("first"),
    )
    ranked = F.struct(
        F.col("votes"),
        F.round(F.try_divide(F.col("total"), F.col("votes")), MEAN_DIGITS).alias("confidence"),
        (-F.col("first")).alias("first"),
        F.col("category"),
    )
    best = tally.groupBy(id_col).agg(F.max(ranked).alias("best"))
    return best.select(
        id_col,
        F.col("best.category").alias(f"{prefix}_category"),
        F.col("best.confidence").alias(f"{prefix}_confidence"),
        F.col("best.votes").alias(f"{prefix}_votes"),
    )


def relabel_low_confidence(df: DataFrame, second: DataFrame, id_col: str, *, below: float = 0.5) -> DataFrame:
    """Replace labels under the limit by a second source's labels where it has them."""
    weak = low_confidence(df, below=below).select(id_col)
    return update_merge(df, second.join(weak, id_col, "left_semi"), id_col)


def pair_agreement(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of equal labels for every pair of models, from one aggregate pass.

    A null label counts as unequal.
    """
    pairs = list(combinations(names, 2))
    shares = [
        F.avg(F.coalesce((F.col(f"{a}_category") == F.col(f"{b}_category")).cast("double"), F.lit(0.0))).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    entries = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.round(F.col(f"p{i}"), 6).alias("agreement"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.agg(*shares).select(F.inline(F.array(*entries)))


def agreement_levels(voted: DataFrame, prefix: str = "ensemble", *, high: int = 4, low: int = 3) -> DataFrame:
    """Rows with at least ``high`` and at most ``low`` votes, with percents."""
    votes = F.col(f"{prefix}_votes")
    counts = voted.agg(
        F.count("*").alias("total"), F.count_if(votes >= high).alias("high"), F.count_if(votes <= low).alias("low")
    )
    return counts.select(
        "total", "high", F.round(100.0 * F.try_divide(F.col("high"), F.col("total")), 4).alias("high_percent"),
        "low", F.round(100.0 * F.try_divide(F.col("low"), F.col("total")), 4).alias("low_percent"),
    )


def full_disagreement(df: DataFrame, n_models: int, id_col: str = "id") -> DataFrame:
    """Ids whose models all give different labels."""
    labels = F.array_distinct(F.transform("predictions", lambda p: p["category"]))
    return df.filter(F.size(labels) == n_models).select(id_col, F.array_sort(labels).alias("labels"))


def against_single(merged: DataFrame, single: str, ensemble: str, votes: str, *, min_votes: int = 4) -> DataFrame:
    """How often the ensemble differs from one model, overall and where votes are high."""
    same = F.coalesce(F.col(single) == F.col(ensemble), F.lit(False))
    strong = F.col(votes) >= min_votes
    counts = merged.agg(
        F.count("*").alias("total"),
        F.count_if(~same).alias("different"),
        F.count_if(strong).alias("strong"),
        F.count_if(strong & same).alias("strong_same"),
    )
    return counts.select(
        "total", "different",
        F.round(F.try_divide(F.col("different"), F.col("total")), 6).alias("different_share"),
        F.round(F.try_divide(F.col("strong_same"), F.col("strong")), 6).alias("strong_agreement"),
    )


def differing_rows(merged: DataFrame, single: str, ensemble: str) -> DataFrame:
    return merged.filter(~F.coalesce(F.col(single) == F.col(ensemble), F.lit(False)))
