"""Group means, annual totals, pivots, ranks, top-k and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from isobar.functions.null_safe import sum0, without_nan
from isobar.functions.scalars import half_even
from isobar.operators.joins import sized_join
from isobar.operators.ordered import SMALL_DISTINCT, value_ranks
from isobar.session import settle


class DuplicateCellError(ValueError):
    """A pivot without aggregation met two values for one cell."""


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def obs_counts(df: DataFrame, key: str, year: str) -> DataFrame:
    """Row counts per key, per year and per both, from one shuffle of counts."""
    by_year, by_key = F.grouping(year) == 1, F.grouping(key) == 1
    level = F.when(by_year, "location").when(by_key, "year").otherwise("location_year")
    sets = df.groupingSets([[key], [year], [key, year]], key, year)
    counted = sets.agg(level.alias("level"), F.count(F.lit(1)).alias("n_obs"))
    # A row without a year still counts for its location, and the other way round.
    keyed = F.col(key).isNotNull() | (F.col("level") == "year")
    return counted.filter(keyed & (F.col(year).isNotNull() | (F.col("level") == "location")))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return _keyed(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs")).orderBy(*keys)


def group_means(df: DataFrame, by: Sequence[str], values: Sequence[str], digits: int | None = None) -> DataFrame:
    """Mean of each value per group, optionally rounded."""
    means = [F.avg(v) if digits is None else half_even(F.avg(v), digits) for v in values]
    named = [m.alias(v) for m, v in zip(means, values)]
    return _keyed(without_nan(df, values), by).groupBy(*by).agg(*named)


def group_means_by_sets(df: DataFrame, sets: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """``group_means`` by several sets of keys from one scan; keys outside a row's set are null.

    Sums fold once by all keys together, so the sets are made from the folded table.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    parts = [F.sum(v).alias(f"_s_{v}") for v in values] + [F.count(v).alias(f"_c_{v}") for v in values]
    folded = without_nan(df, values).groupBy(*keys).agg(*parts)
    grouped = folded.groupingSets([list(s) for s in sets], *keys)
    means = [F.try_divide(F.sum(f"_s_{v}"), F.sum(f"_c_{v}")).alias(v) for v in values]
    out = grouped.agg(F.grouping_id().alias("_set"), *means)
    # A row without one of its own keys drops out.
    whole = F.lit(False)
    for s in sets:
        code = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        own = F.col("_set") == code
        for k in s:
            own = own & F.col(k).isNotNull()
        whole = whole | own
    return out.filter(whole).drop("_set")


def means_with_counts(df: DataFrame, by: Sequence[str], means: dict[str, str]) -> DataFrame:
    """Named means plus the row count per group, in key order."""
    named = [F.avg(v).alias(name) for name, v in means.items()]
    rows = _keyed(without_nan(df, list(means.values())), by)
    return rows.groupBy(*by).agg(*named, F.count(F.lit(1)).alias("n_obs")).orderBy(*by)


def location_aggregate(
    df: DataFrame,
    by: Sequence[str],
    means: dict[str, str],
    totals: dict[str, str] | None = None,
    year: str = "year",
    years: str = "group",
) -> DataFrame:
    """Means and per-year totals by location with its constants carried as keys.

    ``years="group"`` divides a total by the years of that location;
    ``years="global"`` by the years present anywhere in the table, which understates
    locations that start late but matches published tables made that way.
    """
    if years not in ("group", "global"):
        raise ValueError("years must be 'group' or 'global'")
    aggs = [F.avg(v).alias(name) for name, v in means.items()]
    source = _keyed(without_nan(df, [*means.values(), *(totals or {}).values()]), by)
    if not totals:
        return source.groupBy(*by).agg(*aggs)
    # Two stages: per (location, year) sums fold map-side, then a short second step
    # over location-years; a distinct count in one stage would expand every row.
    parts = [F.sum(v).alias(f"_s_{n}") for n, v in means.items()]
    parts += [F.count(v).alias(f"_c_{n}") for n, v in means.items()]
    parts += [sum0(v).alias(f"_t_{n}") for n, v in totals.items()]
    yearly = source.groupBy(*by, year).agg(*parts)
    if years == "group":
        n_years: Column = F.count(year)
    else:
        n_years = df.select(year).distinct().agg(F.count(year)).scalar()
    out = [F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_c_{n}")).alias(n) for n in means]
    totals_out = {n: F.sum(f"_t_{n}") for n in totals}
    grouped = yearly.groupBy(*by).agg(
        *out,
        *[c.alias(f"_sum_{n}") for n, c in totals_out.items()],
        F.count(year).alias("_years"),
    )
    divisor = F.col("_years") if years == "group" else n_years
    annual = [F.try_divide(F.col(f"_sum_{n}"), divisor).alias(n) for n in totals]
    return grouped.select(*by, *means, *annual)


def sorted_by(df: DataFrame, first: str, *then: str, descending: bool = False) -> DataFrame:
    lead = F.desc_nulls_last(first) if descending else F.asc_nulls_last(first)
    return df.orderBy(lead, *then)


def mean_of_totals(df: DataFrame, by: Sequence[str], within: str, value: str) -> DataFrame:
    """Total per (group, within), then the mean of those totals per group."""
    totals = _keyed(without_nan(df, [value]), [*by, within]).groupBy(*by, within).agg(sum0(value).alias(value))
    return totals.groupBy(*by).agg(F.avg(value).alias(value))


def daily_means(df: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """Mean of each measure per station and calendar day."""
    day = F.to_date(ts).alias("date")
    return _keyed(without_nan(df, values), [key, ts]).groupBy(key, day).agg(*[F.avg(v).alias(v) for v in values])


def pivot_mean(df: DataFrame, row: str, column: str, labels: Sequence, value: str) -> DataFrame:
    """Row x column table of means; listed labels fix the order and fill absent ones."""
    return _keyed(without_nan(df, [value]), [row]).groupBy(row).pivot(column, list(labels)).agg(F.avg(value))


def pivot_cells(df: DataFrame, row: str, column: str, labels: Sequence, value: str) -> DataFrame:
    """Row x column table of single values; a repeated cell is an error."""
    twice = df.groupBy(row, column).count().filter("count > 1").limit(1).collect()
    if twice:
        raise DuplicateCellError(f"several values for {row}={twice[0][0]}, {column}={twice[0][1]}")
    return df.groupBy(row).pivot(column, list(labels)).agg(F.first(value, ignorenulls=True))


def rank_within(
    df: DataFrame, by: str, value: str, descending: bool = True, small: int = SMALL_DISTINCT
) -> DataFrame:
    """Average rank of ``value`` inside each ``by`` group, appended as ``rank``.

    ``df`` is settled, so that the ranks join back on the very doubles that were ranked.
    """
    df = settle(df)
    ranks = value_ranks(df, value, [by], descending=descending, small=small)
    lookup = ranks.select(by, value, F.col("avg_rank").alias("rank"))
    return df.join(lookup, [by, value], "left")


def rank_by_period(df: DataFrame, key: str, period: str, value: str, labels: Sequence) -> DataFrame:
    """Rank of every key by mean value in each period, one column per period."""
    ranked = rank_within(group_means(df, [period, key], [value]), period, value)
    return pivot_cells(ranked, key, period, labels, "rank")


def top_rows(df: DataFrame, value: str, columns: Sequence[str], ties: Sequence[str], k: int = 10) -> DataFrame:
    """The k rows with the largest value; ties resolved by the given columns."""
    rows = without_nan(df.select(*columns)).filter(F.col(value).isNotNull())
    return rows.orderBy(F.desc(value), *ties).limit(k)


def in_key_order(df: DataFrame, key: str, order: Sequence, rest: bool = True) -> DataFrame:
    """Rows in a given key order; listed keys without data give a null row.

    With ``rest`` keys outside the list follow at the end instead of vanishing.
    """
    listed = df.sparkSession.createDataFrame(
        [(k, i) for i, k in enumerate(order)], df.select(key).schema.add("_at", IntegerType())
    )
    out = listed.join(df, key, "left")
    if rest:
        others = df.join(F.broadcast(listed.select(key)), key, "left_anti").withColumn("_at", F.lit(len(order)))
        out = out.unionByName(others)
    return out.orderBy("_at", key).drop("_at")


def best_by(df: DataFrame, label: str, score: str) -> DataFrame:
    """The label of the row with the smallest score."""
    return df.agg(F.min_by(label, score).alias(label), F.min(score).alias(score))


def seeded_order(seed: int, *keys: str) -> Column:
    """A reproducible random order of rows, the same under any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.md5(text)


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most n rows chosen by hash order of their key.

    One count puts a cut on the hash axis below which about twice n rows lie, and only those
    are put in order; should fewer than n lie there, the cut is raised.
    """
    axis = F.conv(F.substring(seeded_order(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    total, share = df.count(), 2.0 * n + 100
    cut = share / total if total else 1.0
    while cut < 1 and df.filter(axis < cut).limit(n).count() < n:
        cut *= 2
    few = df if cut >= 1 else df.filter(axis < cut)
    return few.orderBy(seeded_order(seed, *keys), *keys).limit(n)


def attach_constants(agg: DataFrame, dim: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Inner join of an aggregate with dimension columns."""
    return sized_join(agg, dim.select(key, *columns), key, "inner")
