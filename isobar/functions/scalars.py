"""Scalar column expressions: calendar, encodings, labels, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Month -> season names of the two-monsoon calendar.
SEASONS = {
    "Northeast Monsoon": (12, 1, 2),
    "First Inter-monsoon": (3, 4),
    "Southwest Monsoon": (5, 6, 7, 8, 9),
    "Second Inter-monsoon": (10, 11),
}


def as_utc(ts) -> Column:
    """Timestamp (or ISO text, or naive timestamp) as an instant in session time."""
    return F.to_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def season(month: Column, seasons: dict[str, tuple[int, ...]] = SEASONS) -> Column:
    *named, (last, _) = seasons.items()
    (first, months), *rest = named
    out = F.when(month.isin(*months), first)
    for label, months in rest:
        out = out.when(month.isin(*months), label)
    return out.when(month.isNotNull(), last)


def calendar(df: DataFrame, ts: str = "timestamp", seasons=SEASONS) -> DataFrame:
    """Append date, year, month, day, hour and season of ``ts``."""
    t = F.col(ts)
    return df.withColumns(
        {
            "date": F.to_date(t),
            "year": F.year(t),
            "month": F.month(t),
            "day": F.dayofmonth(t),
            "hour": F.hour(t),
            "season": season(F.month(t), seasons),
        }
    )


def cyclic(df: DataFrame, **periods: float) -> DataFrame:
    """Append ``<col>_sin`` and ``<col>_cos`` for each ``col=period``."""
    new = {}
    for name, period in periods.items():
        angle = F.lit(2 * math.pi) * F.col(name) / F.lit(float(period))
        new[f"{name}_sin"] = F.sin(angle)
        new[f"{name}_cos"] = F.cos(angle)
    return df.withColumns(new)


def half_even(col: Column, digits: int) -> Column:
    """Rounding to the even neighbour on ties, as data-frame libraries do."""
    return F.bround(col, digits)


def range_label(lo: float, hi: float) -> str:
    return f"[{lo:g}, {hi:g}]"


def heat_colour(value: Column, low: Column, high: Column) -> Column:
    """Blue-to-red ``#rr30bb`` of a value between ``low`` and ``high``."""
    span = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    red = (span * 255).cast("int")
    blue = ((F.lit(1.0) - span) * 255).cast("int")
    return F.format_string("#%02x30%02x", red, blue)


def marker_radius(value: Column, low: Column) -> Column:
    return F.lit(10.0) + (value - low) * 4


def fixed_text(template: str, *cols: Column) -> Column:
    """``printf``-style label with fixed decimals."""
    return F.format_string(template, *cols)


def path_key(path: Column, key: str) -> Column:
    """Value of ``key=value`` inside a file path."""
    return F.regexp_extract(path, rf"(?:^|/){key}=([^/]+)", 1)
