"""Pearson and Spearman correlation at row, group and location level."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from isobar.functions.null_safe import guarded_corr, safe_corr, without_nan
from isobar.functions.tails import pearson_p
from isobar.operators.joins import BROADCAST_ROWS, shuffle_width
from isobar.operators.moments import corr_of_moments, pair_moments
from isobar.operators.ordered import SMALL_DISTINCT, value_ranks
from isobar.session import settle

Pair = tuple[str, str]


def _names(columns: Sequence[str], index: Column) -> Column:
    return F.array(*[F.lit(c) for c in columns])[index]


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, n, r) for every unordered pair, each over its complete rows."""
    sums = pair_moments(df, columns).filter("i < j")
    return sums.select(
        _names(columns, F.col("i")).alias("x"),
        _names(columns, F.col("j")).alias("y"),
        F.col("n").cast("long").alias("n"),
        corr_of_moments().alias("r"),
    )


def matrix_form(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Square table: one row per variable in the given order, ones on the diagonal."""
    spark = pairs.sparkSession
    own = spark.createDataFrame([(c, c, 1.0) for c in columns], "x string, y string, r double")
    both = pairs.select("x", "y", "r").unionByName(
        pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "r")
    ).unionByName(own)
    at = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("x"))
    wide = both.groupBy("x").pivot("y", list(columns)).agg(F.first("r"))
    return wide.orderBy(at).withColumnRenamed("x", "variable")


#: Slices of a long column's axis for every partition of the shuffle.
_SLICES = 4


def _cut_axes(numbers: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Append the slice of each column's value, a non-decreasing function of it; (table, slice column by column).

    Axes are cut at approximate quantiles. An even slice holds one value, the cut itself; an
    odd one the values up to the next cut, about as many rows in each whatever the shape of
    the data. A value that alone fills several slices is a cut.
    """
    if not columns:
        return numbers, {}
    n = max(2, _SLICES * shuffle_width(numbers))
    probs = [i / n for i in range(1, n)]
    found = numbers.agg(*[F.percentile_approx(c, probs, max(1_000, 10 * n)) for c in columns]).first()
    out, names = numbers, {}
    for c, cuts in zip(columns, found):
        # A column without finite cuts is one slice between two that are empty or infinite.
        inner = sorted({v for v in cuts if math.isfinite(v)}) or [0.0]
        splits = [float("-inf"), *inner, float("inf")]
        # Rows without the value get no slice.
        axis = out.withColumn("_axis", F.coalesce(c, F.lit(inner[0])))
        cut = Bucketizer(splits=splits, inputCol="_axis", outputCol="_at").transform(axis)
        above = F.col(c) > F.element_at(F.lit(splits), F.col("_at").cast("int") + 1)
        names[c] = f"{c}__slice"
        out = cut.withColumn(names[c], F.col("_at") * 2 + above.cast("int")).drop("_axis", "_at")
    return out, names


def _rank_in_slices(rows: DataFrame, column: str, slice_col: str, sizes: dict[int, tuple[float, int]]) -> DataFrame:
    """Append the average rank as ``<column>__rank``; the rows are shuffled and sorted once, by slice.

    ``sizes`` gives the rows before a slice and in it. An even slice holds one value, whose rank is
    known from these, so its rows may lie in many tasks.
    """
    wide = max(sizes, default=0) + 1
    before, inside = (F.lit([float(sizes.get(i, (0.0, 0))[k]) for i in range(wide)]) for k in (0, 1))
    at = F.col(slice_col).cast("int")
    even = at % 2 == 0
    dealt = rows.withColumn("_deal", F.when(even, F.spark_partition_id()).otherwise(F.lit(-1)))
    order = Window.partitionBy(slice_col, "_deal").orderBy(column)
    # The default frame goes up to the last row of equal value.
    middle = (F.rank().over(order) + F.count(F.lit(1)).over(order)) / F.lit(2.0)
    own = F.when(even, (F.element_at(inside, at + 1) + 1) / F.lit(2.0)).otherwise(middle)
    return dealt.withColumn(f"{column}__rank", F.element_at(before, at + 1) + own).drop("_deal")


def spearman_pairs(df: DataFrame, pairs: Sequence[Pair], small: int = SMALL_DISTINCT) -> DataFrame:
    """(x, y, n, rho): Pearson of average ranks over the complete rows of each pair.

    Pairs without gaps share one set of ranks. Pairs that touch columns with gaps are
    ranked on the rows where those columns are set, once per combination of them.
    Columns of up to about ``BROADCAST_ROWS`` distinct values meet their ranks in a broadcast
    join; the rows are sorted by each longer one, slice by slice.
    """
    return _spearman(df, pairs, small)[0]


def _spearman(df: DataFrame, pairs: Sequence[Pair], small: int) -> tuple[DataFrame, dict[str, int]]:
    """The table above and the distinct counts of short columns ranked on all their rows."""
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    # Adding zero makes one value of 0.0 and -0.0.
    numbers = without_nan(df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in cols]), cols)
    seen = [(F.count_if(F.col(c).isNull()), F.approx_count_distinct(c)) for c in cols]
    first = numbers.agg(*[s for both in seen for s in both]).first()
    holed = {c for i, c in enumerate(cols) if first[2 * i]}
    keyed, slices = _cut_axes(numbers, [c for i, c in enumerate(cols) if first[2 * i + 1] > BROADCAST_ROWS])
    groups: dict[frozenset, list[Pair]] = {}
    for x, y in pairs:
        groups.setdefault(frozenset({x, y} & holed), []).append((x, y))

    # One pass counts the values of short columns and the slices of long ones for all combinations.
    places = {}
    for g, (needed, wanted) in enumerate(groups.items()):
        for c in dict.fromkeys(c for pair in wanted for c in pair):
            value = F.col(slices.get(c, c))
            for other in sorted(needed):
                value = F.when(F.col(other).isNotNull(), value)
            places[g, c] = value.alias(f"{g}_{c}")
    names = {key: f"{key[0]}_{key[1]}" for key in places}
    tall = keyed.select(*places.values()).unpivot([], list(names.values()), "variable", "value")
    ranks = settle(value_ranks(tall, "value", ["variable"], small=small))
    in_slices = [n for (_, c), n in names.items() if c in slices]
    before = (F.col("avg_rank") - (F.col("_c") + 1) / F.lit(2.0)).alias("before")
    sizes: dict[str, dict[int, tuple[float, int]]] = {n: {} for n in in_slices}
    for r in ranks.filter(F.col("variable").isin(in_slices)).select("variable", F.col("value").cast("int").alias("at"), before, "_c").collect():
        sizes[r["variable"]][r["at"]] = (r["before"], r["_c"])
    found = ranks.filter(~F.col("variable").isin(in_slices)).groupBy("variable").agg(F.count(F.lit(1)).alias("k")).collect()
    distinct = {r["variable"]: r["k"] for r in found}

    parts, known = [], {}
    for g, (needed, wanted) in enumerate(groups.items()):
        use = [c for at, c in places if at == g]
        rows = keyed
        for c in sorted(needed):
            rows = rows.filter(F.col(c).isNotNull())
        rows = rows.select(*use, *[slices[c] for c in use if c in slices])
        for c in use:
            if c not in slices:
                own = ranks.filter(F.col("variable") == names[g, c])
                lookup = own.select(F.col("value").alias(c), F.col("avg_rank").alias(f"{c}__rank"))
                rows = rows.join(F.broadcast(lookup), c, "left").drop(c)
                if needed == {c} & holed:
                    known[c] = distinct.get(names[g, c], 0)
        for c in use:
            if c in slices:
                rows = _rank_in_slices(rows, c, slices[c], sizes[names[g, c]]).drop(c, slices[c])
        ranked = rows.select(*[F.col(f"{c}__rank").alias(c) for c in use])
        parts.append(_in_order(pearson_pairs(ranked, use), wanted))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("r", "rho"), known


def _in_order(symmetric: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """The listed ordered pairs out of a table of unordered ones."""
    rows = [(x, y) for x, y in pairs]
    wanted = symmetric.sparkSession.createDataFrame(rows, "x string, y string")
    flipped = symmetric.select(F.col("y").alias("x"), F.col("x").alias("y"), "n", "r")
    return F.broadcast(wanted).join(symmetric.unionByName(flipped), ["x", "y"])


def spearman_all_pairs(df: DataFrame, columns: Sequence[str], small: int = SMALL_DISTINCT) -> DataFrame:
    """(x, y, n, r) Spearman for every unordered pair of columns."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    return spearman_pairs(df, pairs, small).withColumnRenamed("rho", "r")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_distinct): distinct non-null values per column."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "value"
    )
    return tall.filter(F.col("value").isNotNull()).groupBy("variable").agg(
        F.count_distinct("value").alias("n_distinct")
    )


def focused_pairs(df: DataFrame, pairs: Sequence[Pair], small: int = SMALL_DISTINCT) -> DataFrame:
    """Row-level r and rho for chosen pairs with p-values and distinct x counts."""
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    pearson = _in_order(pearson_pairs(df, cols), pairs).select("x", "y", F.col("r").alias("pearson_r"))
    ranked, known = _spearman(df, pairs, small)
    counted = df.sparkSession.createDataFrame(list(known.items()), "variable string, n_distinct long")
    rest = [x for x in dict.fromkeys(x for x, _ in pairs) if x not in known]
    distinct = counted.unionByName(distinct_counts(df, rest)) if rest else counted
    # All three tables hold one row per pair or column.
    out = ranked.join(F.broadcast(pearson), ["x", "y"], "left")
    out = out.join(F.broadcast(distinct), F.col("x") == F.col("variable"), "left")
    return out.select(
        "x",
        "y",
        "pearson_r",
        pearson_p("pearson_r", "n").alias("pearson_p"),
        F.col("rho").alias("spearman_r"),
        pearson_p("rho", "n").alias("spearman_p"),
        F.col("n_distinct").alias("n_distinct_x_values"),
        F.col("n").alias("n_rows"),
    )


def location_pairs(agg: DataFrame, pairs: Sequence[Pair], distinct: int = 3) -> DataFrame:
    """Pearson of location-level values; pairs with absent columns are skipped,
    pairs whose x takes fewer than ``distinct`` values drop out."""
    use = [(x, y) for x, y in pairs if x in agg.columns and y in agg.columns]
    xs = list(dict.fromkeys(x for x, _ in use))
    agg = without_nan(agg)
    counted = distinct_counts(agg, xs)
    rows = agg.agg(F.array(*_pair_structs(use)).alias("t")).select(F.explode("t").alias("q")).select("q.*")
    kept = rows.join(F.broadcast(counted), F.col("x") == F.col("variable")).filter(F.col("n_distinct") >= distinct)
    return kept.select("x", "y", F.col("r").alias("pearson_r"), pearson_p("r", "n").alias("pearson_p"), "n")


def _pair_structs(pairs: Sequence[Pair]) -> list[Column]:
    return [
        F.struct(
            F.lit(x).alias("x"),
            F.lit(y).alias("y"),
            safe_corr(x, y).alias("r"),
            F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
        )
        for x, y in pairs
    ]


def height_relationships(agg: DataFrame, height: str, variables: Sequence[str], status: str) -> DataFrame:
    """Pearson and Spearman of each variable with height over locations."""
    pairs = [(height, v) for v in variables]
    full = focused_pairs(agg, pairs)
    enough = F.col("n_distinct_x_values") > 2
    masked = [F.when(enough, F.col(c)).alias(c) for c in ("pearson_r", "pearson_p", "spearman_r", "spearman_p")]
    return full.select(
        F.col("y").alias("variable"),
        *masked,
        F.col("n_rows").alias("n_locations"),
        F.lit(status).alias("elevation_variation_status"),
    )


def corr_by_group(df: DataFrame, by: str, x: str, y: str, distinct: int = 3) -> DataFrame:
    """Pearson of x and y inside each group; null below ``distinct`` x values."""
    r = guarded_corr(x, y, distinct).alias("pearson_r")
    return without_nan(df, [x, y]).filter(F.col(by).isNotNull()).groupBy(by).agg(r).orderBy(by)


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r, p and standard error of y on x; null below 3 distinct x."""
    fit = without_nan(df, [x, y]).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(x).alias("distinct_x"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        safe_corr(x, y).alias("r"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
    ).filter("distinct_x > 2")
    noise = (F.lit(1.0) - F.col("r") * F.col("r")) * F.col("syy")
    error = F.sqrt(F.try_divide(noise, F.col("sxx") * (F.col("n") - 2)))
    return fit.select("n", "slope", "intercept", "r", pearson_p("r", "n").alias("p_value"), error.alias("std_err"))
