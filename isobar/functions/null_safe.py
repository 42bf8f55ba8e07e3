"""Aggregates whose null and zero-denominator rules follow data-frame practice.

Spark's ANSI mode turns a zero denominator into a failed job, so every ratio goes
through ``try_divide`` and every correlation through moments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def sum0(col) -> Column:
    """Sum that is 0, not null, over nothing."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def without_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes null in the floating ones of ``columns``, by default in all."""
    floating = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (DoubleType, FloatType)) and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floating}) if floating else df


def safe_corr(x, y) -> Column:
    """Pearson r over complete pairs; null when either side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def guarded_corr(x, y, distinct: int = 3) -> Column:
    """``safe_corr`` only where x takes at least ``distinct`` values."""
    return F.when(F.count_distinct(x) >= distinct, safe_corr(x, y))


def sample_skew(col) -> Column:
    """Bias-corrected skewness (G1); null for n < 3 or no spread."""
    n = F.count(col).cast("double")
    spread = F.coalesce(F.stddev_pop(col), F.lit(0.0))
    g1 = F.when((n > 2) & (spread > 0), F.skewness(col))
    return F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
