"""Vector columns over ``array<double>``: norms, pairwise measures, normalising.

These are row-local expressions. Products of many vectors with many vectors are
in ``operators.similarity``, which works on blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest norm when normalising, and the offset used by the matcher.
NORM_FLOOR = 1e-9
MATCH_NORM_OFFSET = 1e-10
# Scores are rounded here so that equal vectors tie exactly wherever they are multiplied.
SCORE_DIGITS = 9


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "dot": dot,
}


def metric(name: str) -> Callable[[Column, Column], Column]:
    """Measure by name; an unknown name is an error."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}, expected one of {sorted(METRICS)}")
    return METRICS[name]


def normalise(vec: Column, *, zero_rule: str = "clip") -> Column:
    """Scale to unit length.

    ``clip`` divides by at least ``NORM_FLOOR``; ``one`` divides a zero vector by
    one; ``none`` has no guard and gives null elements for a zero vector.
    """
    size = norm(vec)
    if zero_rule == "clip":
        by = F.greatest(size, F.lit(NORM_FLOOR))
    elif zero_rule == "one":
        by = F.when(size == 0, F.lit(1.0)).otherwise(size)
    elif zero_rule == "none":
        by = size
    else:
        raise ValueError(f"unknown zero rule {zero_rule!r}")
    return F.transform(vec, lambda x: F.try_divide(x, by))
