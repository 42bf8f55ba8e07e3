"""Tables behind histograms, density curves, box plots, fits and residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from isobar.functions.null_safe import without_nan
from isobar.operators.joins import settled_join
from isobar.operators.ordered import SMALL_DISTINCT, bracket_percentiles, present
from isobar.operators.quality import long_form
from isobar.session import settle


def _real(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return long_form(df, columns, keep).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _spread(tall: DataFrame) -> DataFrame:
    """(variable, total, lo, hi, sd): settled, one row per listed column."""
    return settle(
        tall.groupBy("variable").agg(
            F.count("value").alias("total"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.stddev_samp("value").alias("sd"),
        )
    )


def _bin_counts(tall: DataFrame, spread: DataFrame, bins: int) -> DataFrame:
    """(variable, bin, bin_low, bin_high, n): the last bin is closed."""
    placed = tall.join(F.broadcast(spread.select("variable", "lo", "hi")), "variable")
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy("variable", "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    low = F.col("lo") + width * F.col("bin")
    return counts.select("variable", "bin", low.alias("bin_low"), (low + width).alias("bin_high"), "n")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """(variable, bin, bin_low, bin_high, n): equal-width bins over each column's range."""
    tall = _real(df, columns)
    return _bin_counts(tall, _spread(tall), bins)


def density(df: DataFrame, columns: Sequence[str], points: int = 200, bins: int = 1024) -> DataFrame:
    """(variable, x, density): Gaussian kernel estimate on an even grid.

    The kernel sums over ``bins`` bin centres instead of rows, so its cost does not
    grow with the table. Bandwidth is Scott's: sd * n^(-1/5).
    """
    tall = _real(df, columns)
    spread = _spread(tall)
    hist = _bin_counts(tall, spread, bins).select(
        "variable", ((F.col("bin_low") + F.col("bin_high")) / 2).alias("centre"), "n"
    )
    both = hist.join(F.broadcast(spread), "variable")
    width = F.col("sd") * F.pow(F.col("total"), F.lit(-0.2))
    grid = both.withColumn("h", width).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    u = F.try_divide(x - F.col("centre"), F.col("h"))
    scale = F.col("total") * F.col("h") * F.sqrt(2 * F.pi())
    part = F.try_divide(F.col("n") * F.exp(F.lit(-0.5) * u * u), scale)
    out = grid.withColumns({"x": x, "part": part}).groupBy("variable", "i")
    return out.agg(F.min("x").alias("x"), F.sum("part").alias("density")).drop("i")


def box_stats(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    reach: float = 1.5,
    small: int = SMALL_DISTINCT,
) -> DataFrame:
    """Quartiles, whisker ends inside the fences and outlier count per group and variable.

    Quartiles come from brackets of a few values; a last pass takes the ends and counts.
    """
    keys = [*by, "variable"]
    tall = present(_real(df, columns, by), by)
    boxes = bracket_percentiles(tall, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys, small=small)
    iqr = F.col("q3") - F.col("q1")
    fenced = boxes.withColumns({"lo": F.col("q1") - iqr * reach, "hi": F.col("q3") + iqr * reach})
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    kept = F.when(inside, F.col("value"))
    return (
        settled_join(tall, fenced.drop("n"), keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(kept).alias("whisker_low"),
            F.max(kept).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by (x - mean) / sample sd."""
    df = without_nan(df, columns)
    stats = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).alias("z")
    ).scalar()
    new = {c: F.try_divide(F.col(c) - stats[c]["m"], stats[c]["s"]) for c in columns}
    return df.withColumns(new)


def fit_line(df: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """The least-squares line of y on x at evenly spaced x; empty below 3 distinct x."""
    fit = present(df, [x, y]).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.count_distinct(x).alias("distinct_x"),
    )
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(points - 1))
    line = fit.filter("distinct_x > 2").select("*", steps).withColumn("x", at)
    return line.select("x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))


def residuals(df: DataFrame, actual: str, fitted: str) -> DataFrame:
    """Append ``residual`` and ``abs_error``."""
    gap = F.col(actual) - F.col(fitted)
    return df.withColumns({"residual": gap, "abs_error": F.abs(gap)})


def binned_scatter(df: DataFrame, x: str, y: str, x_step: float, y_step: float) -> DataFrame:
    """Counts on a grid of cells: a scatter plot's data at any table size."""
    cells = present(df, [x, y]).groupBy(
        F.floor(F.col(x) / F.lit(x_step)).alias("x_cell"), F.floor(F.col(y) / F.lit(y_step)).alias("y_cell")
    )
    return cells.agg(F.count(F.lit(1)).alias("n"))
