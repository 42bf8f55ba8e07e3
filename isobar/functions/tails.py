"""Tail probabilities of the t, F, chi-square and normal distributions.

Each is a short numeric routine on a handful of test statistics; the statistics
themselves come from Spark aggregates. The ``*_p`` pandas UDFs put them on result
tables, which hold one row per test.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

_TINY = 1e-300


def _fraction(step, limit: int = 20000) -> float:
    """Modified Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...))."""
    b0 = step(0)[1] or _TINY
    f, c, d = b0, b0, 0.0
    for i in range(1, limit):
        a, b = step(i)
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1.0 / d
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return f


def beta_regularised(x: float, a: float, b: float) -> float:
    """I_x(a, b) by its continued fraction."""
    if math.isnan(x):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularised(1.0 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    log_front += a * math.log(x) + b * math.log1p(-x)

    def step(i):
        if i == 0:
            return 0.0, 1.0
        m, odd = divmod(i, 2)
        if odd:
            a_i = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            a_i = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return a_i, 1.0

    return math.exp(log_front) / (a * _fraction(step))


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x): series below the bend, continued fraction above it."""
    if math.isnan(x):
        return math.nan
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * math.exp(log_front)

    def step(i):
        if i == 0:
            return 0.0, x + 1.0 - a
        return -i * (i - a), x + 2 * i + 1.0 - a

    return math.exp(log_front) / _fraction(step)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_regularised(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def pearson_two_sided(r: float, n: float) -> float:
    """p of a correlation r on n pairs: t with n-2 degrees of freedom."""
    if math.isnan(r) or n < 3:
        return math.nan
    return beta_regularised(max(0.0, 1.0 - r * r), (n - 2) / 2.0, 0.5)


def _vectorised(fn):
    def run(*cols: pd.Series) -> pd.Series:
        def one(*args):
            args = [math.nan if a is None else float(a) for a in args]
            if any(map(math.isnan, args)):
                return None
            out = fn(*args)
            return None if math.isnan(out) else out

        return pd.Series([one(*row) for row in zip(*cols)], dtype="object").astype("Float64")

    return run


def _udf(fn, arity: int):
    run = _vectorised(fn)
    if arity == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return F.pandas_udf(two, "double")

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf(three, "double")


def pearson_p(r, n):
    return _udf(pearson_two_sided, 2)(r, n)


def chi2_p(x, df):
    return _udf(chi2_upper, 2)(x, df)


def f_p(f, d1, d2):
    return _udf(f_upper, 3)(f, d1, d2)
