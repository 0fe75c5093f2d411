"""Row-local majority vote over an array of predictions.

A document's predictions by all models fit in one row (one entry per model), so
a vote over them needs no shuffle. Entries are structs with the fields
``model_pos``, ``category``, ``confidence`` and optionally ``weight``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Means are rounded so that the order of addition cannot decide a tie.
MEAN_DIGITS = 12


def vote(predictions: Column, *, weighted: bool = False) -> Column:
    """Struct ``(category, confidence, votes)`` of the winning label.

    Most votes win, then the highest mean confidence, then the model that comes
    first. Entries without label or confidence do not vote; with none left the
    label and confidence are null and votes is 0.
    """
    valid = F.filter(predictions, lambda p: p["category"].isNotNull() & p["confidence"].isNotNull())

    def weight(p: Column) -> Column:
        return p["weight"].cast("long") if weighted else F.lit(1).cast("long")

    def tally(name: Column) -> Column:
        mine = F.filter(valid, lambda p: p["category"] == name)
        votes = F.aggregate(mine, F.lit(0).cast("long"), lambda acc, p: acc + weight(p))
        total = F.aggregate(mine, F.lit(0.0), lambda acc, p: acc + p["confidence"] * weight(p))
        first = F.array_min(F.transform(mine, lambda p: p["model_pos"]))
        # The largest struct wins, so the first model is the largest -model_pos.
        return F.struct(
            votes.alias("votes"),
            F.round(F.try_divide(total, votes), MEAN_DIGITS).alias("confidence"),
            (-first).alias("first"),
            name.alias("category"),
        )

    names = F.array_distinct(F.transform(valid, lambda p: p["category"]))
    best = F.array_max(F.transform(names, tally))
    return F.struct(
        best["category"].alias("category"),
        best["confidence"].alias("confidence"),
        F.coalesce(best["votes"], F.lit(0).cast("long")).alias("votes"),
    )
