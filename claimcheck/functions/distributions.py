"""Survival functions of the t, F and chi-square distributions, for result rows.

Spark has none of these. They are evaluated in Arrow batches of the few rows that an aggregation leaves,
by the continued fractions of the incomplete beta and gamma functions; a small p-value is found as such,
not as one minus something close to one.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY, _CLOSE, _STEPS = 1e-300, 1e-15, 100_000


def _fraction(terms) -> float:
    """Value of 1 / (1 + a1 / (1 + a2 / (1 + ...))) by the modified Lentz method."""
    value, c, d = 1.0, 1.0, 0.0
    for a in terms:
        d = 1.0 / ((1.0 + a * d) or _TINY)
        c = (1.0 + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _CLOSE:
            break
    return 1.0 / value


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def terms():
        for k in range(1, _STEPS):
            m = k // 2
            if k % 2:
                yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return front * _fraction(terms())


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for k in range(1, _STEPS):
            term *= x / (a + k)
            total += term
            if term < total * _CLOSE:
                break
        return 1.0 - front * total
    # 1 / (x + 1 - a - 1(1 - a) / (x + 3 - a - ...)), from its first step on
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for k in range(1, _STEPS):
        step = -k * (k - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or _TINY)
        c = (b + step / c) or _TINY
        value *= d * c
        if abs(d * c - 1.0) < _CLOSE:
            break
    return front * value


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_tail(dof / (dof + t * t), dof / 2.0, 0.5)


def f_upper(f: float, dof1: float, dof2: float) -> float:
    if math.isinf(f):
        return 0.0
    return beta_tail(dof2 / (dof2 + dof1 * f), dof2 / 2.0, dof1 / 2.0)


def chi2_upper(x: float, dof: float) -> float:
    return gamma_tail(dof / 2.0, x / 2.0)


def _column(function, *arguments: Column) -> Column:
    name = function.__name__

    @F.arrow_udf("double")
    def tail(*batches: pa.Array) -> pa.Array:
        from claimcheck.functions import distributions

        of = getattr(distributions, name)
        rows = zip(*[b.to_pylist() for b in batches])
        return pa.array([None if any(x is None or x != x for x in row) or min(row[1:]) <= 0 else of(*row) for row in rows], pa.float64())

    return tail(*[a.cast("double") for a in arguments])


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a t statistic; null where an argument is missing or the degrees of freedom aren't positive."""
    return _column(t_two_sided, t, dof)


def f_p_value(f: Column, dof1: Column, dof2: Column) -> Column:
    return _column(f_upper, f, dof1, dof2)


def chi2_p_value(x: Column, dof: Column) -> Column:
    return _column(chi2_upper, x, dof)
