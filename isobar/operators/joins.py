"""Fact-to-dimension joins with their checks and reports."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from isobar.operators.ordered import present
from isobar.session import settle

# Largest dimension, in rows, that is copied to every executor.
BROADCAST_ROWS = 200_000


class ManyToOneError(ValueError):
    """The dimension repeats a join key."""


class MergeCheckError(ValueError):
    """A merge lost, duplicated or failed to match rows."""


def repeated_keys(dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return dim.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def key_profile(dim: DataFrame, on: Sequence[str]) -> tuple[int, int]:
    """(rows, largest number of rows of one key) of a dimension."""
    per_key = dim.groupBy(*on).agg(F.count(F.lit(1)).alias("_c"))
    row = per_key.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.max("_c"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_shares(fact: DataFrame, on: str, share: float | None = None) -> dict:
    """Key values holding more than ``share`` of all rows, with their shares: at most 1/share keys.

    By default a key is hot when it alone is more than an even partition of the shuffle.
    """
    share = 1.0 / shuffle_width(fact) if share is None else share
    counts = present(fact, [on]).groupBy(on).agg(F.count(F.lit(1)).alias("_c"))
    part = F.col("_c") / counts.agg(F.sum("_c").alias("t")).scalar()
    return {row[0]: row[1] for row in counts.select(on, part.alias("_part")).filter(F.col("_part") > share).collect()}


def hot_keys(fact: DataFrame, on: str, share: float | None = None) -> list:
    """The keys of ``hot_shares``."""
    return list(hot_shares(fact, on, share))


def _keys_by_salts(hot: Mapping | Sequence, wide: int) -> dict[int, list]:
    """Hot keys by their number of salts: twice their share of all partitions, as a power of two."""
    shares = hot if isinstance(hot, Mapping) else dict.fromkeys(hot, 1.0)
    out: dict[int, list] = {}
    for key, share in shares.items():
        out.setdefault(1 << max(1, math.ceil(math.log2(2 * share * wide))), []).append(key)
    return out


def salted_join(fact: DataFrame, dim: DataFrame, on: str, hot: Mapping | Sequence, how: str) -> DataFrame:
    """Shuffle join that spreads the rows of each hot key over tasks by its share.

    ``hot`` gives keys with their shares of the rows; keys alone are spread over all
    tasks. Only the hot rows of the dimension are repeated. Rows with a null key, which
    match nothing, are spread over as many tasks as the shuffle has.
    """
    wide = shuffle_width(fact)
    rest = F.xxhash64(*fact.columns)
    salt = F.when(F.col(on).isNull(), F.pmod(rest, F.lit(wide)))
    copies = F.array(F.lit(0))
    for salts, keys in _keys_by_salts(hot, wide).items():
        salt = salt.when(F.col(on).isin(keys), F.pmod(rest, F.lit(salts)))
        copies = F.when(F.col(on).isin(keys), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(copies)
    left = fact.withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int"))
    right = dim.withColumn("_salt", F.explode(copies))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def sized_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "left",
    rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join that broadcasts ``dim`` only after counting it, and salts hot keys beyond."""
    if rows is None:
        rows = dim.limit(broadcast_rows + 1).count()
    if rows <= broadcast_rows:
        return fact.join(F.broadcast(dim), on, how)
    return salted_join(fact, dim, on, hot_shares(fact, on), how)


def settled_join(facts: DataFrame, groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of facts to a per-group result, which is settled and counted first.

    Up to the broadcast bound the facts are not shuffled, so a hot group stays spread
    as it was.
    """
    kept = settle(groups)
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    return facts.join(kept, list(on))


def join_checked(
    fact: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "left",
    validate: str | None = "many_to_one",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi-join to a dimension whose key must be unique.

    The check is one aggregate over the dimension and also yields its row count,
    which decides between broadcast and salted shuffle join.
    """
    rows, copies = key_profile(dim, [on])
    if validate == "many_to_one" and copies > 1:
        raise ManyToOneError(f"{on} repeats up to {copies} times in the dimension")
    return sized_join(fact, dim, on, how, rows, broadcast_rows)


def location_reference(
    dim: DataFrame, fact: DataFrame, key: str, flag_ids: Sequence, order_by: str, flag: str = "is_original"
) -> DataFrame:
    """Dimension rows whose key has data, flagged by a list and sorted."""
    keys = fact.select(key).distinct()
    kept = dim.join(keys, key, "left_semi").withColumn(flag, F.col(key).isin(*flag_ids))
    return kept.orderBy(F.col(order_by).asc_nulls_last(), key)


def merge_report(
    fact: DataFrame, merged: DataFrame, key: str, ts: str, matched: str
) -> DataFrame:
    """One row: rows before/after/lost, duplicate keys, unmatched rows, extent."""
    before = fact.agg(F.count(F.lit(1)).alias("b"))
    unmatched = F.sum(F.when(F.col(matched).isNull(), 1).otherwise(0))
    # A station-hour is the unit: repeated ones fold map-side before the shuffle.
    per_key = merged.groupBy(key, ts).agg(F.count(F.lit(1)).alias("_c"), unmatched.alias("_u"))
    # A station-year table is tiny, so the distinct counts below cost nothing.
    per_year = per_key.groupBy(key, F.year(ts).alias("_year")).agg(
        F.sum("_c").alias("_c"),
        F.sum(F.col("_c") - 1).alias("_d"),
        F.sum("_u").alias("_u"),
        F.min(ts).alias("_lo"),
        F.max(ts).alias("_hi"),
    )
    one = per_year.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("rows_after_merge"),
        F.coalesce(F.sum("_d"), F.lit(0)).alias("duplicate_records_after_merge"),
        F.coalesce(F.sum("_u"), F.lit(0)).alias("unmatched_rows"),
        F.count_distinct(key).alias("n_locations"),
        F.count_distinct("_year").alias("n_years"),
        F.min("_lo").alias("date_min"),
        F.max("_hi").alias("date_max"),
    )
    return one.select(
        before.scalar().alias("rows_before_merge"),
        "rows_after_merge",
        (before.scalar() - F.col("rows_after_merge")).alias("rows_lost"),
        "duplicate_records_after_merge",
        "unmatched_rows",
        "n_locations",
        "n_years",
        "date_min",
        "date_max",
    )


def assert_merge(report: DataFrame) -> DataFrame:
    """Raise unless the report shows no loss, no duplicates and no unmatched rows."""
    row = report.first()
    for name in ("rows_lost", "duplicate_records_after_merge", "unmatched_rows"):
        if row[name] != 0:
            raise MergeCheckError(f"{name} = {row[name]}")
    return report
