"""Missingness, bounds, duplicates, describe tables and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from isobar.functions.null_safe import missing, percent, sample_skew, without_nan
from isobar.functions.scalars import half_even, range_label
from isobar.operators.joins import sized_join
from isobar.operators.ordered import SMALL_DISTINCT, bracket_percentiles, previous_place
from isobar.session import settle


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., variable, value) with every column as double."""
    cast = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*keep, *cast).unpivot(list(keep), list(columns), "variable", "value")


def _row_to_rows(one: DataFrame, names: Sequence[str], fields: dict[str, str], label: str) -> DataFrame:
    """Turn a one-row table of ``field_i`` columns into one row per name."""
    items = [
        F.struct(F.lit(name).alias(label), *[F.col(f"{p}{i}").alias(out) for out, p in fields.items()])
        for i, name in enumerate(names)
    ]
    extra = [c for c in one.columns if c == "_n"]
    return one.select(*extra, F.explode(F.array(*items)).alias("r")).select(*extra, "r.*")


def missing_overall(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Missing count and share of every column, most missing first: one scan."""
    names = list(columns or df.columns)
    counts = [F.coalesce(F.sum(missing(df, c).cast("long")), F.lit(0)).alias(f"m{i}") for i, c in enumerate(names)]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *counts)
    rows = _row_to_rows(one, names, {"missing_count": "m"}, "column")
    share = half_even(percent(F.col("missing_count"), F.col("_n")), digits)
    return rows.select("column", "missing_count", share.alias("missing_pct")).orderBy(
        F.desc("missing_pct"), "column"
    )


def with_any_missing(overall: DataFrame) -> DataFrame:
    return overall.filter(F.col("missing_count") > 0)


def missing_by_group(df: DataFrame, by: str, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Missing share of each column per group."""
    shares = [half_even(F.avg(missing(df, c).cast("double")) * 100, digits).alias(c) for c in columns]
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(*shares).orderBy(by)


def missing_count_by_group(df: DataFrame, by: str, column: str) -> DataFrame:
    n = F.count_if(missing(df, column)).alias("missing_count")
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(n).orderBy(by)


def bounds_check(df: DataFrame, bounds: dict[str, tuple[float, float]], digits: int = 4) -> DataFrame:
    """Values outside a closed interval per column; absent columns are skipped."""
    names = [c for c in bounds if c in df.columns]
    df = without_nan(df, names)
    bad = []
    for i, c in enumerate(names):
        lo, hi = bounds[c]
        outside = (F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))
        bad.append(F.coalesce(F.sum(F.when(outside, 1).otherwise(0)), F.lit(0)).alias(f"b{i}"))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *bad)
    rows = _row_to_rows(one, names, {"n_invalid": "b"}, "column")
    labels = F.create_map(*[F.lit(x) for c in names for x in (c, range_label(*bounds[c]))])
    share = half_even(percent(F.col("n_invalid"), F.col("_n")), digits)
    return rows.select("column", labels[F.col("column")].alias("valid_range"), "n_invalid", share.alias("pct_invalid"))


def outside_years(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    """How many timestamps lie outside the inclusive year window."""
    bad = ~F.year(ts).between(first, last)
    return df.agg(F.count_if(bad).alias("n_outside"))


def positive_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows above zero per column, for measures expected to be zero."""
    df = without_nan(df, columns)
    one = df.agg(*[F.count_if(F.col(c) > 0).alias(f"p{i}") for i, c in enumerate(columns)])
    return _row_to_rows(one, columns, {"n_positive": "p"}, "column")


def duplicate_rows(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each distinct row (or key); nulls compare equal."""
    if key is None:
        return duplicate_report(df, df.columns[:1]).select(F.col("exact_duplicates").alias("n_duplicates"))
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates"))


def duplicate_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Exact and key duplicates in one row.

    A first pass shuffles keys and a 128-bit digest of every row; whole rows are compared
    only inside a digest that occurs again, so unique rows never travel whole.
    """
    digest = F.struct(F.xxhash64(*df.columns), F.xxhash64(F.lit("second"), *reversed(df.columns)))
    seen = settle(df.select(*key, digest.alias("_digest")).groupBy(*key, "_digest").agg(F.count(F.lit(1)).alias("_c")))
    per_key = seen.groupBy(*key).agg(F.sum("_c").alias("_n"))
    keyed = per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("key_duplicates"))
    again = seen.filter("_c > 1").select("_digest").distinct()
    suspects = sized_join(df.withColumn("_digest", digest), again, "_digest", "inner").drop("_digest")
    per_row = suspects.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    exact = per_row.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("exact_duplicates"))
    return exact.select("exact_duplicates", keyed.scalar().alias("key_duplicates"))


def describe(df: DataFrame, columns: Sequence[str], small: int = SMALL_DISTINCT) -> DataFrame:
    """count, mean, std, min, quartiles, max and bias-corrected skew per column.

    Moments and the brackets of the quartiles come from one pass, the quartiles themselves
    from the few values inside the brackets; no table of values is made.
    """
    tall = long_form(df, columns).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    moments = [
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), sample_skew("value").alias("skew"),
    ]
    out = bracket_percentiles(tall, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["variable"], moments, small=small)
    return out.select("variable", F.col("n").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max", "skew")


def table_profile(df: DataFrame, key: str, year: str, n_files: int | None = None, n_bytes: int | None = None) -> DataFrame:
    """Rows, distinct keys and years, columns and, where known, file sizes."""
    per = df.groupBy(key, year).agg(F.count(F.lit(1)).alias("_c"))
    out = per.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("total_rows"),
        F.count_distinct(key).alias("total_locations"),
        F.count_distinct(year).alias("total_years"),
    ).withColumn("total_columns", F.lit(len(df.columns)))
    if n_files is None:
        return out
    megabytes = half_even(F.lit(n_bytes) / F.lit(1e6), 3)
    per_row = half_even(F.try_divide(F.lit(float(n_bytes)), F.col("total_rows")), 2)
    return out.select(
        "*",
        F.lit(n_files).alias("n_files"),
        megabytes.alias("size_mb"),
        per_row.alias("avg_bytes_per_row"),
    )


def time_deltas(df: DataFrame, key: str, ts: str, small: int = SMALL_DISTINCT) -> DataFrame:
    """(key, ts, copies, delta_seconds): gap to the station's previous distinct time.

    ``copies - 1`` further rows at the same instant have a gap of zero.
    """
    stamped = df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    gaps = previous_place(stamped, "_us", [key], small)
    delta = (F.col("_us") - F.col("previous")) / F.lit(1e6)
    return gaps.select(key, F.timestamp_micros("_us").alias(ts), F.col("_c").alias("copies"), delta.alias("delta_seconds"))


def common_deltas(df: DataFrame, key: str, ts: str, top: int = 5, small: int = SMALL_DISTINCT) -> DataFrame:
    """The most frequent time steps: the table's resolution."""
    gaps = time_deltas(df, key, ts, small)
    step = F.struct(F.col("delta_seconds").alias("d"), F.lit(1).cast("long").alias("w"))
    repeat = F.struct(F.lit(0.0).alias("d"), (F.col("copies") - 1).alias("w"))
    each = gaps.select(F.explode(F.array(step, repeat)).alias("s")).filter("s.d IS NOT NULL AND s.w > 0")
    counts = each.groupBy(F.col("s.d").alias("delta_seconds")).agg(F.sum("s.w").alias("n"))
    return counts.orderBy(F.desc("n"), "delta_seconds").limit(top)


def expected_hours(year: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(leap, F.lit(8784)).otherwise(F.lit(8760))


def coverage(keys: DataFrame, df: DataFrame, key: str, year: str, first: int, last: int) -> DataFrame:
    """Every expected (key, year) with hours expected, rows found and completion.

    The year list is a constant array exploded per key.
    """
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year)
    grid = keys.select(key, years)
    found = df.groupBy(key, F.col(year).cast("int").alias(year)).agg(F.count(F.lit(1)).alias("n_obs"))
    full = grid.join(found, [key, year], "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    hours = expected_hours(F.col(year))
    return full.select(
        key,
        year,
        hours.alias("expected_hours"),
        "n_obs",
        (F.col("n_obs") > 0).alias("present"),
        percent(F.col("n_obs"), hours).alias("completion_pct"),
    )


def missing_chunks(keys: DataFrame, df: DataFrame, key: str, year: str, first: int, last: int) -> DataFrame:
    """Expected (key, year) pairs without any row."""
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year)
    have = df.select(key, F.col(year).cast("int").alias(year)).distinct()
    return keys.select(key, years).join(have, [key, year], "left_anti")


def hour_gaps(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Hours inside a station's own span that hold no row."""
    hours = df.select(key, F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour_start")).distinct()
    span = hours.groupBy(key).agg(F.min("hour_start").alias("lo"), F.max("hour_start").alias("hi"))
    # Days first, then hours, so a long span is spread over many rows before it grows.
    days = F.explode(F.sequence(F.date_trunc("day", "lo"), F.col("hi"), F.expr("interval 1 day")))
    by_day = span.select(key, "lo", "hi", days.alias("day"))
    until = F.col("day") + F.expr("interval 23 hours")
    each = F.explode(F.sequence(F.col("day"), until, F.expr("interval 1 hour"))).alias("hour_start")
    grid = by_day.select(key, "lo", "hi", each).filter(F.col("hour_start").between(F.col("lo"), F.col("hi")))
    return grid.select(key, "hour_start").join(hours, [key, "hour_start"], "left_anti")


def rolling_usage(
    df: DataFrame, source: str, epoch: str, cost: str, windows: dict[str, int], block: int = 86_400
) -> DataFrame:
    """Trailing cost sums per source over ``windows`` of seconds, both ends included.

    Costs are first added up per second. A window then runs per (source, block of
    time); the tail of the previous block is copied forward, so a busy source is
    spread over its blocks and each holds at most ``block`` plus the longest window
    of seconds.
    """
    longest = max(windows.values())
    block = max(block, longest)
    per = df.groupBy(source, F.col(epoch).cast("long").alias("epoch")).agg(F.sum(cost).alias("cost"))
    home = F.floor(F.col("epoch") / F.lit(block))
    spill = F.floor((F.col("epoch") + F.lit(longest)) / F.lit(block))
    copies = per.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, spill)))
    w = Window.partitionBy(source, "_block").orderBy("epoch")
    sums = {name: F.sum("cost").over(w.rangeBetween(-secs, 0)) for name, secs in windows.items()}
    out = copies.withColumns(sums).filter(F.col("_home") == F.col("_block"))
    return out.select(source, "epoch", "cost", *windows)
