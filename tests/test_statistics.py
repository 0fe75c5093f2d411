"""Tail probabilities against closed forms and tabled values."""

import math

import pytest
from pyspark.sql import functions as F

from taskatlas.functions.statistics import two_sided_p


def closed(t, df):
    if df == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if df == 2:
        return 1 - t / math.sqrt(2 + t * t)
    if df == 3:
        u = t / math.sqrt(3)
        return 1 - 2 / math.pi * (u / (1 + u * u) + math.atan(u))
    u = 1 + t * t / 4
    return 1 - 0.75 * t / math.sqrt(u) * (1 - t * t / u / 12)


# The last ones: limits of the normal curve, erfc(t / sqrt(2)), for very many degrees of freedom.
CASES = [(t, df, closed(t, df)) for t in (0.0, 0.1, 1.0, 2.5, 7.0) for df in (1, 2, 3, 4)]
CASES += [(2.0, 10, 0.0733880347707), (-2.0, 10, 0.0733880347707)]
CASES += [(t, 10**12, math.erfc(t / math.sqrt(2))) for t in (0.5, 1.96, 5.0)]


def test_p_values(spark):
    rows = spark.createDataFrame([(float(t), df, p) for t, df, p in CASES], "t double, df long, p double")
    for r in rows.withColumn("found", two_sided_p(F.col("t"), F.col("df"))).collect():
        assert r["found"] == pytest.approx(r["p"], abs=1e-9), (r["t"], r["df"])


def test_far_tails_stay_relative(spark):
    rows = spark.createDataFrame([(40.0, 4), (300.0, 2), (12.0, 10**12)], "t double, df long")
    found = [r[0] for r in rows.select(two_sided_p(F.col("t"), F.col("df"))).collect()]
    # Two degrees of freedom: the exact difference from 1 has no digits left, 1 / t^2 is its limit.
    assert found[1] == pytest.approx(1 / 300**2, rel=1e-4)
    assert found[2] == pytest.approx(math.erfc(12 / math.sqrt(2)), rel=1e-4)
    assert 0 < found[0] < 1e-5


def test_no_degrees_of_freedom(spark):
    rows = spark.createDataFrame([(1.0, 0), (None, 5), (1.0, -1), (float("nan"), 5)], "t double, df long")
    assert [r[0] for r in rows.select(two_sided_p(F.col("t"), F.col("df"))).collect()] == [None] * 4
