"""Group comparison tests: statistics from Spark, p-values on the one-row result."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from isobar.functions import texts
from isobar.functions.null_safe import safe_corr, without_nan
from isobar.functions.tails import chi2_p, f_p, normal_upper, pearson_p
from isobar.operators.joins import settled_join
from isobar.operators.ordered import SMALL_DISTINCT, histogram_of, lowest_per_group, present, value_counts
from isobar.operators.rollup import seeded_order
from isobar.session import settle

ALPHA = 0.05

# Polynomial coefficients published for the W test (Royston 1995, AS R94),
# lowest power first.
_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -0.0006714)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)
_G = (-2.273, 0.459)


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: statistic, df1, df2, p_value."""
    per = present(df, [group, value]).groupBy(group).agg(
        F.count(value).cast("double").alias("_n"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count(value)).alias("_ss")
    )
    return _f_test(per)


def _f_test(per: DataFrame) -> DataFrame:
    """F statistic from (_n, _m, _ss) per group: size, mean, squares about the mean."""
    centre = per.agg(F.try_divide(F.sum(F.col("_n") * F.col("_m")), F.sum("_n"))).scalar()
    gap = F.col("_m") - centre
    sums = per.agg(
        F.sum(F.col("_n") * gap * gap).alias("between"),
        F.sum("_ss").alias("within"),
        (F.count(F.lit(1)) - 1).cast("double").alias("df1"),
        (F.sum("_n") - F.count(F.lit(1))).alias("df2"),
    )
    ratio = F.try_divide(F.try_divide(F.col("between"), F.col("df1")), F.try_divide(F.col("within"), F.col("df2")))
    one = sums.select(ratio.alias("statistic"), "df1", "df2")
    return one.withColumn("p_value", f_p("statistic", "df1", "df2"))


def levene(df: DataFrame, group: str, value: str, small: int = SMALL_DISTINCT) -> DataFrame:
    """Equality of variances about the group medians."""
    hist = histogram_of(value_counts(df, value, [group]), value, [group], small)
    gaps = settled_join(hist.df, hist.percentiles({"_median": 0.5}), [group])
    gaps = gaps.withColumn("_gap", F.abs(F.col(value) - F.col("_median")))
    c, g = F.col("_c"), F.col("_gap")
    means = gaps.groupBy(group).agg(F.sum(c).cast("double").alias("_n"), (F.sum(c * g) / F.sum(c)).alias("_m"))
    off = g - F.col("_m")
    per = settled_join(gaps, means, [group]).groupBy(group, "_n", "_m").agg(F.sum(c * off * off).alias("_ss"))
    return _f_test(per)


def kruskal(df: DataFrame, group: str, value: str, small: int = SMALL_DISTINCT) -> DataFrame:
    """Kruskal-Wallis H with tie correction: statistic, df, p_value.

    One pass folds rows to (group, value, count); ranks are taken over the values.
    """
    cells = settle(value_counts(df, value, [group]).withColumnRenamed("_c", "_k"))
    overall = cells.groupBy(value).agg(F.sum("_k").alias("_c"))
    ranks = histogram_of(overall, value, (), small).ranks()
    per = (
        cells.join(ranks.select(value, "avg_rank", "n"), value)
        .groupBy(group)
        .agg(
            F.sum("_k").cast("double").alias("_k"),
            F.sum(F.col("_k") * (F.col("avg_rank") - (F.col("n") + 1) / F.lit(2.0))).alias("_s"),
            F.max("n").cast("double").alias("n"),
        )
    )
    t, n = F.col("_c").cast("double"), F.col("n").cast("double")
    ties = ranks.agg(F.try_divide(F.sum(t * t * t - t), F.max(n * n * n - n))).scalar()
    spread = per.agg(
        F.sum(F.col("_s") * F.col("_s") / F.col("_k")).alias("b"),
        F.max("n").alias("n"),
        (F.count(F.lit(1)) - 1).cast("double").alias("df"),
    )
    h = F.try_divide(F.lit(12.0) * F.col("b"), F.col("n") * (F.col("n") + 1))
    one = spread.select(F.try_divide(h, F.lit(1.0) - ties).alias("statistic"), "df")
    return one.withColumn("p_value", chi2_p("statistic", "df"))


def jarque_bera(df: DataFrame, group: str, value: str) -> DataFrame:
    """Normality per group from one pass of moments, for groups of any size."""
    n = F.count(value).cast("double")
    s, k = F.skewness(value), F.kurtosis(value)
    stat = n / 6.0 * (s * s + k * k / 4.0)
    per = present(df, [group, value]).groupBy(group).agg(
        F.count(value).alias("n"), F.when(F.var_pop(value) > 0, stat).alias("statistic")
    )
    # Two degrees of freedom have a closed tail.
    return per.withColumn("p_value", F.exp(F.col("statistic") / -2.0))


def _poly(coefs: Sequence[float], x: float) -> float:
    return float(sum(c * x**i for i, c in enumerate(coefs)))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p of one sample of 8 to 5000 values."""
    x = np.sort(np.asarray(x, dtype="float64"))
    n = len(x)
    if x[-1] == x[0]:
        return 1.0, 1.0
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    u = 1.0 / math.sqrt(n)
    last = m[-1] / math.sqrt(ssq) + _poly(_C1, u)
    second = m[-2] / math.sqrt(ssq) + _poly(_C2, u)
    phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / math.sqrt(phi)
    a[[0, 1, -2, -1]] = -last, -second, second, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if w == 1.0:
        return 1.0, 1.0
    log_n = math.log(n)
    if n <= 11:
        y = -math.log(_poly(_G, n) - math.log1p(-w))
        mean, sd = _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        y = math.log1p(-w)
        mean, sd = _poly(_C5, log_n), math.exp(_poly(_C6, log_n))
    return w, normal_upper((y - mean) / sd)


def shapiro_by_group(
    df: DataFrame, group: str, value: str, keys: Sequence[str], n: int = 4999, at_least: int = 8, seed: int = 42
) -> DataFrame:
    """Shapiro-Wilk per group on at most ``n`` rows in seeded order; W is only
    defined for small samples, so this limit is part of the test."""
    rows = present(df, [group, value])
    spread = F.xxhash64(*[F.col(k) for k in keys])
    sample = lowest_per_group(rows, [group], [seeded_order(seed, *keys), F.col(value)], n, spread)
    kind = df.schema[group].dataType.simpleString()

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < at_least:
            empty = {"n": pd.Series(dtype="int64"), "w": pd.Series(dtype="float64"), "p_value": pd.Series(dtype="float64")}
            return pd.DataFrame({group: pdf[group].iloc[:0], **empty})
        w, p = shapiro_wilk(pdf[value].to_numpy())
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [len(pdf)], "w": [w], "p_value": [p]})

    picked = sample.select(group, F.col(value).cast("double").alias(value))
    return picked.groupBy(group).applyInPandas(test, f"{group} {kind}, n long, w double, p_value double")


def _verdict(p: Column, reject: str) -> Column:
    return F.when(p < ALPHA, reject).otherwise(texts.KEPT)


def _result(one: DataFrame, name: str, used: str, reject: str) -> DataFrame:
    return one.select(
        F.lit(name).alias("test"),
        F.lit(used).alias("test_used"),
        "statistic",
        "p_value",
        _verdict(F.col("p_value"), reject).alias("conclusion"),
    )


def compare_locations(
    daily: DataFrame, group: str, value: str, keys: Sequence[str], name: str, small: int = SMALL_DISTINCT
) -> DataFrame:
    """ANOVA where all groups look normal with equal variances, else Kruskal-Wallis."""
    shapes = shapiro_by_group(daily, group, value, keys)
    odd = shapes.filter(F.col("p_value") <= ALPHA).limit(1).count()
    equal = odd == 0 and (levene(daily, group, value, small).first().p_value or 0.0) > ALPHA
    if equal:
        return _result(anova(daily, group, value), name, texts.ANOVA_USED, texts.LOCATIONS_DIFFER)
    return _result(kruskal(daily, group, value, small), name, texts.KRUSKAL_CHOSEN, texts.LOCATIONS_DIFFER)


def compare_ranks(daily: DataFrame, group: str, value: str, name: str, small: int = SMALL_DISTINCT) -> DataFrame:
    """Kruskal-Wallis without assumption checks, for skewed zero-inflated measures."""
    return _result(kruskal(daily, group, value, small), name, texts.KRUSKAL_USED, texts.LOCATIONS_DIFFER)


def location_correlation(agg: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Pearson test of two location-level columns."""
    agg = without_nan(agg, [x, y])
    one = agg.agg(safe_corr(x, y).alias("statistic"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
    return _result(one.withColumn("p_value", pearson_p("statistic", "n")), name, texts.PEARSON_USED, texts.REJECTED)


def battery(
    df: DataFrame,
    key: str,
    ts: str,
    compare: dict[str, str],
    ranks: dict[str, str],
    relations: dict[str, tuple[str, str]],
    small: int = SMALL_DISTINCT,
) -> DataFrame:
    """All tests of a study in one summary table.

    ``compare`` and ``ranks`` name daily-mean tests (name -> measure); ``relations``
    names location-level ones (name -> (location constant, measure)).
    """
    constants = sorted({x for x, _ in relations.values()})
    measures = sorted({*compare.values(), *ranks.values(), *(y for _, y in relations.values())})
    df = without_nan(df, [*measures, *constants])
    # One pass over the facts: daily means, and what location means are made of.
    day = F.to_date(ts).alias("date")
    parts = [F.avg(m).alias(m) for m in measures]
    parts += [F.sum(m).alias(f"_sum_{m}") for m in measures] + [F.count(m).alias(f"_n_{m}") for m in measures]
    parts += [F.min(c).alias(f"_at_{c}") for c in constants]
    daily = settle(present(df, [key, ts]).groupBy(key, day).agg(*parts))
    rows = [compare_locations(daily, key, v, [key, "date"], name, small) for name, v in compare.items()]
    rows += [compare_ranks(daily, key, v, name, small) for name, v in ranks.items()]
    agg = daily.groupBy(key).agg(
        *[F.min(f"_at_{c}").alias(c) for c in constants],
        *[F.try_divide(F.sum(f"_sum_{m}"), F.sum(f"_n_{m}")).alias(m) for m in measures],
    )
    for name, (x, y) in relations.items():
        rows.append(location_correlation(agg, x, y, name))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
