"""NaN next to null: both are missing, in every operator that measures."""

import math

import pytest
from pyspark.sql import functions as F

from isobar.operators import correlation, distribution, geo, hypothesis, models, quality, regression, rollup
from isobar.operators.moments import corr_of_moments, pair_moments

NAN = float("nan")


@pytest.fixture(scope="module")
def tables(spark):
    """Rows with NaN and null holes, and the same rows with null holes only."""
    rows = [(f"g{i % 3}", 2000 + i % 4, float(i * i % 17), float((i * 7) % 23) + i / 10, float(i % 5)) for i in range(60)]
    rows = [(g, y, NAN if i % 11 == 3 else None if i % 13 == 5 else a, NAN if i % 17 == 2 else b, c) for i, (g, y, a, b, c) in enumerate(rows)]
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    schema = "g string, year int, a double, b double, c double"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(clean, schema)


CASES = {
    "bounds": lambda d: quality.bounds_check(d, {"a": (0, 10), "b": (1, 20)}),
    "positive": lambda d: quality.positive_counts(d, ["a", "b"]),
    "group_means": lambda d: rollup.group_means(d, ["g"], ["a", "b"]),
    "means_with_counts": lambda d: rollup.means_with_counts(d, ["g"], {"m": "a"}),
    "mean_of_totals": lambda d: rollup.mean_of_totals(d, ["g"], "year", "a"),
    "pivot": lambda d: rollup.pivot_mean(d, "g", "year", [2000, 2001, 2002, 2003], "a"),
    "top": lambda d: rollup.top_rows(d, "a", ["a", "b"], ["b"], 5),
    "rank": lambda d: rollup.rank_by_period(d, "g", "year", "a", [2000, 2001, 2002, 2003]),
    "z": lambda d: distribution.z_scores(d, ["a", "b"]).select("a", "b"),
    "line": lambda d: distribution.fit_line(d, "a", "b", 3),
    "pearson": lambda d: correlation.pearson_pairs(d, ["a", "b", "c"]),
    "by_group": lambda d: correlation.corr_by_group(d, "g", "a", "b"),
    "line_fit": lambda d: correlation.line_fit(d, "a", "b"),
    "anova": lambda d: hypothesis.anova(d, "g", "a"),
    "levene": lambda d: hypothesis.levene(d, "g", "a"),
    "kruskal": lambda d: hypothesis.kruskal(d, "g", "a"),
    "location": lambda d: rollup.location_aggregate(d, ["g"], {"m": "a"}, {"t": "a", "u": "b"}),
    "location_means": lambda d: rollup.location_aggregate(d, ["g"], {"m": "a"}),
    "sets": lambda d: rollup.group_means_by_sets(d, [["g", "year"], ["g"]], ["a", "b"]),
    "span": lambda d: geo.span_gate(d, "a"),
    "thirds": lambda d: geo.tertile_means(d, "a", ["b"]),
    "baseline": lambda d: models.evaluate(models.mean_baseline(d, d, "a"), "a", {"m": "prediction"}),
    "error": lambda d: models.error_by_group(models.mean_baseline(d, d, "a"), "g", "a", "prediction"),
    "relation": lambda d: hypothesis.location_correlation(d, "a", "b", "t").drop("conclusion"),
    "describe": lambda d: quality.describe(d, ["a", "b"]),
    "box": lambda d: distribution.box_stats(d, ["a", "b"], ["g"]),
}


def shown(df):
    return sorted(
        [tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in df.collect()]
    )


@pytest.mark.parametrize("case", sorted(CASES))
def test_nan_counts_as_null(tables, case):
    holed, clean = tables
    got = shown(CASES[case](holed))
    assert got == shown(CASES[case](clean))
    assert got and not any("nan" in v for r in got for v in r)


def test_regression_skips_nan(tables):
    a, b = (regression.fit_clustered(t, "a", ["b"], "g") for t in tables)
    assert a.r_squared == pytest.approx(b.r_squared) and not math.isnan(a.r_squared)


def test_counts_keep_rows_without_a_year(spark):
    df = spark.createDataFrame([("x", 2000), ("x", None), (None, 2000)], "k string, year int")
    got = {(r.level, r.k, r.year): r.n_obs for r in rollup.obs_counts(df, "k", "year").collect()}
    assert got == {("location", "x", None): 2, ("year", None, 2000): 2, ("location_year", "x", 2000): 1}


def test_correlation_does_not_depend_on_the_first_rows(spark):
    later = spark.range(400).select(
        F.when(F.col("id") > 100, F.col("id") * 1e-3 + 1.7e9).alias("a"), (F.col("id") * 2e-3 + 1.7e9).alias("b")
    )
    r = pair_moments(later, ["a", "b"]).where("i < j").select(corr_of_moments().alias("r")).first().r
    assert r == pytest.approx(1.0, abs=1e-6)
