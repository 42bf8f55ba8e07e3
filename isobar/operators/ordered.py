"""Order statistics without one big sort in one task.

Average ranks and exact percentiles need the rows of a group in order. A window over the group would put a station holding a third of
the data into a single task, so the work runs on a histogram instead:

1. ``groupBy(group, value).count()`` is the only pass over the facts; map-side combine
   folds hot values, and the result is written once to the checkpoint folder;
2. where a group has many distinct values, the value axis is cut at approximate
   quantiles of the histogram, so each (group, slice) stays small whatever the
   shape of the data;
3. windows run inside (group, slice), and one small table of slice totals per group
   carries the running offset across slices.

The cuts only decide where rows are processed; results are exact. Measurements on a
coarse grid have few distinct values however many rows there are, and then the
histogram is tiny. Gaps between places on a whole-number axis (``previous_place``) need
no histogram: the axis is cut into blocks, and each block carries one place to the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from isobar.functions.null_safe import without_nan
from isobar.session import settle

# Most distinct values a group may have before its axis is cut.
SMALL_DISTINCT = 100_000
_SLICE = "_slice"


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all ``columns`` set: null group keys and null or NaN values drop out."""
    df = without_nan(df, columns)
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(group..., value, _c): how often each value occurs in each group."""
    return present(df, [*by, value]).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))


@dataclass(frozen=True)
class Histogram:
    """(group..., value, _c) with the inner cut points of its value axis, if any."""

    df: DataFrame
    value: str
    by: tuple[str, ...]
    cuts: list[float] = field(default_factory=list)

    def _keyed(self) -> DataFrame:
        """Append the slice number, a non-decreasing function of the value."""
        if not self.cuts:
            return self.df.withColumn(_SLICE, F.lit(0))
        splits = [float("-inf"), *self.cuts, float("inf")]
        axis = self.df.withColumn("_axis", F.col(self.value).cast("double"))
        cut = Bucketizer(splits=splits, inputCol="_axis", outputCol="_at").transform(axis)
        return cut.withColumn(_SLICE, F.col("_at").cast("int")).drop("_axis", "_at")

    def _offsets(self, keyed: DataFrame) -> DataFrame:
        """(group..., slice, _offset, _t, n): rows below, inside and overall.

        One row per slice and group, so the windows are as short as the slice list.
        """
        totals = keyed.groupBy(*self.by, _SLICE).agg(F.sum("_c").alias("_t"))
        whole = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))
        earlier = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *self.by,
            _SLICE,
            F.coalesce(F.sum("_t").over(earlier), F.lit(0).cast("long")).alias("_offset"),
            "_t",
            F.sum("_t").over(whole).alias("n"),
        )

    def _running(self, keyed: DataFrame) -> DataFrame:
        """Append ``before``: rows of the same group and slice with a smaller value."""
        w = Window.partitionBy(*self.by, _SLICE).orderBy(self.value)
        upto = w.rowsBetween(Window.unboundedPreceding, -1)
        return keyed.withColumn("before", F.coalesce(F.sum("_c").over(upto), F.lit(0).cast("long")))

    def running(self) -> DataFrame:
        """Append ``before`` (rows of the group with a smaller value) and ``n`` (its rows)."""
        keyed = self._keyed()
        inside = self._running(keyed)
        if not self.cuts:
            whole = Window.partitionBy(*self.by, _SLICE)
            return inside.withColumn("n", F.sum("_c").over(whole)).drop(_SLICE)
        out = inside.join(self._offsets(keyed).drop("_t"), [*self.by, _SLICE], "inner")
        return out.withColumn("before", F.col("before") + F.col("_offset")).drop("_offset", _SLICE)

    def ranks(self, descending: bool = False) -> DataFrame:
        """(group..., value, _c, n, avg_rank): average rank of each distinct value."""
        below = F.col("n") - F.col("before") - F.col("_c") if descending else F.col("before")
        rank = below.cast("double") + (F.col("_c") + 1) / F.lit(2.0)
        return self.running().withColumn("avg_rank", rank).drop("before")

    def percentiles(self, probs: dict[str, float]) -> DataFrame:
        """One row per group with a linearly interpolated percentile per name."""
        if not self.cuts:
            # The value -> count map of a group holds at most SMALL_DISTINCT entries.
            wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
            wide = self.df.groupBy(*self.by).agg(F.percentile(self.value, wanted, F.col("_c")).alias("_p"))
            return wide.select(*self.by, *[F.col("_p")[i].alias(name) for i, name in enumerate(probs)])
        low, high, share = {}, {}, {}
        for name, p in probs.items():
            at = (F.col("n") - 1) * F.lit(float(p))
            low[name] = F.floor(at)
            high[name] = F.least(low[name] + 1, F.col("n") - 1)
            share[name] = at - low[name]

        def within(k: Column, start: str, length: str) -> Column:
            return (F.col(start) <= k) & (k < F.col(start) + F.col(length))

        # Only slices that hold one of the wanted positions are put in order.
        keyed = self._keyed()
        hit, wanted = F.lit(False), F.lit(False)
        for k in (*low.values(), *high.values()):
            hit = hit | within(k, "_offset", "_t")
            wanted = wanted | within(k, "before", "_c")
        chosen = self._offsets(keyed).filter(hit).drop("_t")
        counts = self._running(keyed.join(chosen, [*self.by, _SLICE], "inner"))
        counts = counts.withColumn("before", F.col("before") + F.col("_offset")).filter(wanted)
        aggs, picked = [], []
        for i, name in enumerate(probs):
            aggs += [
                F.max(F.when(within(low[name], "before", "_c"), F.col(self.value))).alias(f"_lo{i}"),
                F.max(F.when(within(high[name], "before", "_c"), F.col(self.value))).alias(f"_hi{i}"),
                F.max(share[name]).alias(f"_w{i}"),
            ]
            lo, hi, w = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")
            picked.append((lo + (hi - lo) * w).alias(name))
        return counts.groupBy(*self.by).agg(*aggs).select(*self.by, *picked)


def histogram_of(
    counts: DataFrame,
    value: str,
    by: Sequence[str] = (),
    small: int = SMALL_DISTINCT,
    slices: int | None = None,
) -> Histogram:
    """Settle a (group..., value, _c) table and cut its axis where a group is long.

    The driver receives one count and at most ``slices`` cut points (default: the
    session's shuffle partitions).
    """
    kept = settle(counts)
    longest = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")).agg(F.max("_k")).first()[0] or 0
    cuts: list[float] = []
    if longest > small:
        n = slices or int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        probs = [i / n for i in range(1, n)]
        if probs:
            axis = F.col(value).cast("double")
            cuts = kept.agg(F.percentile_approx(axis, probs, max(1_000, 10 * n))).first()[0]
    return Histogram(kept, value, tuple(by), sorted(set(cuts)))


def value_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False, small: int = SMALL_DISTINCT
) -> DataFrame:
    """(group..., value, _c, n, avg_rank): average rank of each distinct value."""
    return histogram_of(value_counts(df, value, by), value, by, small).ranks(descending)


def exact_percentiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), small: int = SMALL_DISTINCT
) -> DataFrame:
    """One row per group with a linearly interpolated percentile per name."""
    return bracket_percentiles(present(df, [*by, value]), value, probs, by, small=small).select(*by, *probs)


#: Accuracy of the brackets: an approximate percentile is off by at most a share of 1 / accuracy of the rows.
ACCURACY = 2_000
#: Most groups whose brackets are copied to all tasks.
SMALL_GROUPS = 50_000


def bracket_percentiles(
    rows: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), aggs: Sequence[Column] = (),
    accuracy: int = ACCURACY, small: int = SMALL_DISTINCT,
) -> DataFrame:
    """(group..., n, ``aggs``, percentiles): exact, linearly interpolated percentiles per group.

    A first pass counts rows and distinct values and whatever ``aggs`` ask. Where no group
    has more than about ``small`` values, they are counted in the aggregate itself. Otherwise
    one pass finds, for each percentile, two values that it lies between, and another
    counts the rows below each bracket and folds those inside it by value, so only the
    brackets are shuffled: a few rows of a thousand. ``rows`` have no missing values.
    """
    if not by:
        whole = rows.withColumn("_all", F.lit(0))
        return bracket_percentiles(whole, value, probs, ["_all"], aggs, accuracy, small).drop("_all")
    sizes = [F.count(F.lit(1)).alias("n"), F.approx_count_distinct(value).alias("_d")]
    first = settle(rows.groupBy(*by).agg(*sizes, *aggs))
    groups, longest = first.agg(F.count("n"), F.coalesce(F.max("_d"), F.lit(0))).first()
    places = F.array(*[F.lit(float(p)) for p in probs.values()])
    if longest <= small:
        found = rows.groupBy(*by).agg(F.percentile(value, places).alias("_p"))
        found = found.select(*by, *[F.col("_p")[i].alias(name) for i, name in enumerate(probs)])
    else:
        found = _between_brackets(rows, value, probs, by, accuracy, groups <= SMALL_GROUPS)
    return first.drop("_d").join(found, list(by))


def _between_brackets(rows: DataFrame, value: str, probs: dict[str, float], by: Sequence[str], accuracy: int, few: bool) -> DataFrame:
    slack = 2.0 / accuracy
    asked = [q for p in probs.values() for q in (max(p - slack, 0.0), min(p + slack, 1.0))]
    about = [F.count(F.lit(1)).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    first = rows.groupBy(*by).agg(*about, F.percentile_approx(value, asked, accuracy).alias("_b"))
    # Below so many rows the slack is less than a row or two, and the whole group is the bracket.
    whole = F.array(*[F.col(c) for _ in probs for c in ("_lo", "_hi")])
    first = settle(first.select(*by, "n", F.when(F.col("n") < 4 * accuracy, whole).otherwise(F.col("_b")).alias("_b")))
    brackets = first.select(*by, "_b")
    paired = rows.join(F.broadcast(brackets) if few else brackets, list(by))
    v, kind = F.col(value), rows.schema[value].dataType
    places = []
    for i in range(len(probs)):
        low, high = F.col("_b")[2 * i], F.col("_b")[2 * i + 1]
        inside = F.struct(F.lit(i).alias("i"), v.alias("v"))
        below = F.struct(F.lit(i).alias("i"), F.lit(None).cast(kind).alias("v"))
        places.append(F.when(v < low, below).when(v <= high, inside))
    each = paired.select(*by, F.explode(F.array(*places)).alias("s")).filter("s IS NOT NULL").select(*by, "s.i", "s.v")
    folded = each.groupBy(*by, "i", "v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    running = folded.withColumn("before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).filter("v IS NOT NULL")
    running = running.join(first.select(*by, "n"), list(by))
    at = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("i") + 1)
    running = running.withColumns({"_low": F.floor(at), "_high": F.least(F.floor(at) + 1, F.col("n") - 1), "_w": at - F.floor(at)})

    def taken(k: str) -> Column:
        found = F.max(F.when((F.col("before") <= F.col(k)) & (F.col(k) < F.col("before") + F.col("_c")), F.col("v")))
        return F.coalesce(found, F.raise_error(F.lit("a percentile lies outside its bracket")).cast(kind))

    ends = running.groupBy(*by, "i").agg(taken("_low").alias("lo"), taken("_high").alias("hi"), F.max("_w").alias("w"))
    point = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, point)).alias(name) for i, name in enumerate(probs)])


def _in_blocks(rows: DataFrame, at: str, by: Sequence[str], small: int) -> tuple[Column, DataFrame] | None:
    """A column that cuts the axis ``at`` into blocks of about ``small`` places, and (group..., _block, _top).

    The width starts from the densest group's mean; while a block is too full, it is set
    by the densest of those. The table holds a row per block that has rows, and is settled.
    None where every group is small enough to be one block.
    """
    places, span = F.approx_count_distinct(at), F.max(at).cast("double") - F.min(at).cast("double") + 1
    groups = rows.groupBy(*by).agg(places.alias("_k"), (places / span).alias("_d"))
    fullest, dense = groups.agg(F.max("_k"), F.max("_d")).first()
    if (fullest or 0) <= small:
        return None
    width = max(1, min(1 << 62, int(small / dense)))
    while True:
        # Whole-number division towards minus infinity, exact beyond 2^53.
        block = F.expr(f"`{at}` div {width} - IF(`{at}` % {width} < 0, 1, 0)").alias("_block")
        found = rows.groupBy(*by, block).agg(F.max(at).alias("_top"), places.alias("_k"), (places / span).alias("_d"))
        tops = settle(found)
        dense = tops.filter(F.col("_k") > 2 * small).agg(F.max("_d")).first()[0]
        if width == 1 or dense is None:
            return block, tops.drop("_k", "_d")
        width = max(1, min(width // 2, int(small / dense)))


def previous_place(df: DataFrame, at: str, by: Sequence[str], small: int = SMALL_DISTINCT) -> DataFrame:
    """(group..., at, _c, previous): the next smaller distinct place of the group on a whole-number axis.

    Equal places are folded before the shuffle, and a block of the axis holds few distinct
    ones whatever its group holds. Each block looks back inside itself; only its last
    place is carried to the next block that has rows, and only those are stored.
    """
    rows = present(df, [*by, at])
    cut = _in_blocks(rows, at, by, small)
    if cut is None:
        counts = rows.groupBy(*by, at).agg(F.count(F.lit(1)).alias("_c"))
        return counts.withColumn("previous", F.lag(at).over(Window.partitionBy(*by).orderBy(at)))
    block, tops = cut
    keys = [*by, "_block"]
    counts = rows.groupBy(*by, block, at).agg(F.count(F.lit(1)).alias("_c"))
    inside = counts.withColumn("previous", F.lag(at).over(Window.partitionBy(*keys).orderBy(at)))
    carried = tops.select(*keys, F.lag("_top").over(Window.partitionBy(*by).orderBy("_block")).alias("_carry"))
    out = inside.join(carried, keys)
    return out.select(*by, at, "_c", F.coalesce("previous", "_carry").alias("previous"))


def lowest_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, spread: Column, parts: int = 64
) -> DataFrame:
    """The ``k`` first rows of every group, found in two rounds.

    Round one keeps k rows of each (group, part); round two sees at most
    ``parts * k`` rows per group, so a hot group never sorts in one task.
    """
    salted = df.withColumn("_part", F.pmod(spread, F.lit(parts)))
    first = Window.partitionBy(*by, "_part").orderBy(*order)
    then = Window.partitionBy(*by).orderBy(*order)
    kept = salted.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= k)
    kept = kept.withColumn("_i", F.row_number().over(then)).filter(F.col("_i") <= k)
    return kept.drop("_i", "_part")
