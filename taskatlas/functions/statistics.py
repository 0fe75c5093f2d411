"""Tail probabilities as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000  # even: Simpson's rule
REACH = 42.0  # exp(-42) of its start is where an integrand ends


def _log_cos(x: Column) -> Column:
    """log(cos x), with all digits near 0 where cos x is all but 1."""
    return -F.log1p(F.pow(F.tan(x), F.lit(2.0))) / 2


def _cosine_tail(start: Column, power: Column) -> Column:
    """Integral of (cos x / cos ``start``) ** ``power`` from ``start`` to a right angle, by Simpson's rule.

    The integrand falls at least like exp(-power (tan(start) x + x x / 2)), so only the
    reach of that is stepped through.
    """
    slope = power * F.tan(start)
    reach = F.try_divide(F.lit(2 * REACH), slope + F.sqrt(slope * slope + 2 * REACH * power))
    width = F.least(F.lit(pi / 2) - start, reach)
    step = width / STEPS

    def term(i: Column) -> Column:
        x = start + step * i
        weight = F.when((i == 0) | (i == STEPS), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
        return weight * F.exp(power * (_log_cos(x) - _log_cos(start)))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + term(i))
    return total * step / 3


def two_sided_p(t: Column, df: Column) -> Column:
    """Chance of a t statistic at least as far from 0, with ``df`` degrees of freedom; null where ``df`` < 1 or t is null.

    With t = sqrt(df) tan(x) the density is proportional to cos(x) ** (df - 1), which
    is integrated numerically at any ``df``.
    """
    df = df.cast("double")
    angle = F.atan(F.abs(t) / F.sqrt(df))
    power = df - 1
    scale = F.exp(power * _log_cos(angle))
    p = scale * _cosine_tail(angle, power) / _cosine_tail(F.lit(0.0), power)
    return F.when((df >= 1) & t.isNotNull() & ~F.isnan(t), F.least(F.lit(1.0), p))
