"""Tests and regressions against NumPy on small frames."""

import math
import re
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.functions import tails
from isobar.operators import correlation, hypothesis, regression
from isobar.operators.moments import gram, pair_moments


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    g = np.repeat(["a", "b", "c"], [40, 60, 80])
    v = np.round(rng.normal(size=180) + (g == "c") * 0.8, 1)
    return pd.DataFrame({"g": g, "v": v, "id": np.arange(180)})


def test_anova_and_levene(spark, groups):
    def f_stat(values):
        parts = [values[groups.g == k] for k in "abc"]
        n, k = len(values), 3
        sb = sum(len(p) * (p.mean() - values.mean()) ** 2 for p in parts)
        sw = sum(((p - p.mean()) ** 2).sum() for p in parts)
        return (sb / (k - 1)) / (sw / (n - k))

    v = groups.v.to_numpy()
    med = groups.groupby("g").v.transform("median").to_numpy()
    df = frame(spark, groups)
    a = hypothesis.anova(df, "g", "v").first()
    assert math.isclose(a.statistic, f_stat(v), rel_tol=1e-10) and (a.df1, a.df2) == (2.0, 177.0)
    assert math.isclose(a.p_value, tails.f_upper(a.statistic, 2, 177))
    for small in (0, 10**6):
        got = hypothesis.levene(df, "g", "v", small).first()
        assert math.isclose(got.statistic, f_stat(np.abs(v - med)), rel_tol=1e-10)


def test_kruskal_with_ties(spark, groups):
    ranks = groups.v.rank()
    n = len(groups)
    h = 12 / (n * (n + 1)) * sum(r.sum() ** 2 / len(r) for _, r in ranks.groupby(groups.g)) - 3 * (n + 1)
    t = groups.v.value_counts().to_numpy().astype(float)
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    for small in (0, 10**6):
        got = hypothesis.kruskal(frame(spark, groups), "g", "v", small).first()
        assert math.isclose(got.statistic, h, rel_tol=1e-10) and got.df == 2.0
        assert math.isclose(got.p_value, math.exp(-h / 2), rel_tol=1e-9)


def test_shapiro_published_example():
    # The eleven weights of the original paper, W = 0.79.
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = hypothesis.shapiro_wilk(np.array(weights))
    assert math.isclose(w, 0.79, abs_tol=0.005) and 0.004 < p < 0.01
    assert math.isclose(p, 0.006703814, rel_tol=1e-6)
    even = np.array([NormalDist().inv_cdf((i + 0.5) / 500) for i in range(500)])
    assert hypothesis.shapiro_wilk(even)[1] > 0.9
    assert hypothesis.shapiro_wilk(np.exp(even))[1] < 1e-10


def test_shapiro_by_group_skips_short_groups(spark, groups):
    short = pd.DataFrame({"g": ["z"] * 5, "v": np.arange(5.0), "id": np.arange(1000, 1005)})
    df = frame(spark, pd.concat([groups, short]))
    got = {r.g: (r.n, r.w) for r in hypothesis.shapiro_by_group(df, "g", "v", ["id"], n=50).collect()}
    assert {g: n for g, (n, _) in got.items()} == {"a": 40, "b": 50, "c": 50}
    assert all(0.8 < w <= 1 for _, w in got.values())


def test_choice_of_test(spark):
    rng = np.random.default_rng(5)
    base = pd.DataFrame({"g": np.repeat(["a", "b"], 60), "date": np.tile(np.arange(60), 2)})
    normal = frame(spark, base.assign(v=rng.normal(size=120)))
    skewed = frame(spark, base.assign(v=rng.exponential(size=120) ** 2))
    assert hypothesis.compare_locations(normal, "g", "v", ["g", "date"], "t").first().test_used == "One-way ANOVA"
    assert hypothesis.compare_locations(skewed, "g", "v", ["g", "date"], "t").first().test_used.startswith("Kruskal")


def test_tails():
    assert math.isclose(tails.chi2_upper(1204.4824040955766, 5), 3.1410143349142327e-258, rel_tol=1e-9)
    assert math.isclose(tails.pearson_two_sided(-0.054623949420179424, 306888), 1.9327964844372727e-201, rel_tol=1e-8)
    assert math.isclose(tails.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-12)
    assert math.isclose(tails.t_two_sided(2.0, 1), 1 - 2 / math.pi * math.atan(2.0), rel_tol=1e-12)
    assert math.isclose(tails.f_upper(3.0, 2, 10), (1 + 0.6) ** -5, rel_tol=1e-12)
    assert tails.chi2_upper(5000.0, 5) == 0.0 and tails.chi2_upper(0.0, 5) == 1.0
    assert tails.pearson_two_sided(1.0, 10) == 0.0 and math.isnan(tails.pearson_two_sided(0.5, 2))


def test_clustered_model_with_factor(spark):
    rng = np.random.default_rng(11)
    n = 900
    g = rng.integers(0, 12, n)
    m = rng.integers(1, 5, n)
    x = rng.normal(size=12)[g] * 3 + 100
    year = rng.integers(2018, 2025, n).astype(float)
    y = 2 + 0.5 * x + 0.1 * (year - 2020) + 0.7 * (m == 3) + rng.normal(size=12)[g] + rng.normal(size=n)
    pdf = pd.DataFrame({"g": g, "m": m, "x": x, "year": year, "y": y})
    df = frame(spark, pdf).union(spark.createDataFrame([(1, 2, None, 2020.0, 1.0)], frame(spark, pdf).schema))
    fit = regression.fit_nested(df, "y", {"f": (("x", "year"), "m"), "s": (("x",), None)}, "g")["f"]
    X = np.column_stack([np.ones(n), m == 2, m == 3, m == 4, x - 100, year - 2020]).astype(float)
    bread = np.linalg.inv(X.T @ X)
    beta = bread @ X.T @ y
    e = y - X @ beta
    s = np.array([X[g == k].T @ e[g == k] for k in range(12)])
    cov = 12 / 11 * (n - 1) / (n - 6) * bread @ (s.T @ s) @ bread
    back = np.eye(6)
    back[0, 4:] = [-100, -2020]
    want, cov = back @ beta, back @ cov @ back.T
    assert fit.terms == ("Intercept", "C(m)[T.2]", "C(m)[T.3]", "C(m)[T.4]", "x", "year")
    assert np.allclose(fit.coef, want, rtol=1e-8)
    assert np.allclose(np.sqrt(np.diag(fit.covariance)), np.sqrt(np.diag(cov)), rtol=1e-7)
    assert math.isclose(fit.r_squared, 1 - (e @ e) / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    assert (fit.n, fit.clusters) == (n, 12)
    fitted = [r.fitted for r in fit.predict(frame(spark, pdf)).orderBy("g", "m", "x", "year", "y").collect()]
    order = pdf.assign(f=X @ beta).sort_values(["g", "m", "x", "year", "y"]).f
    assert np.allclose(fitted, order)


def test_absorbed_factor_equals_a_dummy_per_level(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 1500
    g, m = rng.integers(0, 15, n), rng.integers(0, 40, n)
    x, z = rng.normal(size=n) + m, rng.normal(size=n) * 5 + 2000
    y = 3 + 0.5 * x - 0.2 * z + np.sin(m) * 4 + rng.normal(size=15)[g] + rng.normal(size=n)
    df = frame(spark, pd.DataFrame({"g": g, "m": m, "x": x, "z": z, "y": y}))
    specs = {"both": (("x", "z"), "m"), "one": (("z",), "m")}
    listed = regression.fit_nested(df, "y", specs, "g")
    monkeypatch.setattr(regression, "LISTED_LEVELS", 39)
    absorbed = regression.fit_nested(df, "y", specs, "g")
    for label, (xs, _) in specs.items():
        a, b = absorbed[label], listed[label]
        k = len(xs)
        assert a.terms == xs and b.terms[-k:] == xs and a.effects.count() == 40
        assert np.allclose(a.coef, b.coef[-k:], rtol=1e-8)
        assert np.allclose(a.covariance, b.covariance[-k:, -k:], rtol=1e-7)
        assert (a.n, a.clusters) == (b.n, b.clusters)
        assert math.isclose(a.r_squared, b.r_squared, rel_tol=1e-9) and math.isclose(a.adj_r_squared, b.adj_r_squared, rel_tol=1e-9)
        order = ["g", "m", "x", "z", "y"]
        one, two = ([r.fitted for r in f.predict(df).orderBy(*order).collect()] for f in (a, b))
        assert np.allclose(one, two)
    new = spark.createDataFrame([(99, 1.0, 2.0), (None, 1.0, 2.0)], "m bigint, x double, z double")
    assert [r.fitted for r in absorbed["both"].predict(new).collect()] == [None, None]
    flat = df.withColumn("x", F.col("m") * 2.0)
    with pytest.raises(ValueError, match="does not vary"):
        regression.fit_clustered(flat, "y", ["x"], "g", "m")


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_correlations_do_not_depend_on_an_offset(spark, offset):
    rng = np.random.default_rng(2)
    # Whole multiples of 2^-20 stay exact beside the offset.
    x = np.rint(rng.normal(size=(500, 3)) * 2**20) / 2**20
    x[::7, 0] = np.nan
    want = pd.DataFrame(x, columns=list("abc")).corr()
    df = frame(spark, pd.DataFrame(x + offset, columns=list("abc"))).repartition(5)
    assert pair_moments(df, list("abc")).count() == 6
    for r in correlation.pearson_pairs(df, list("abc")).collect():
        assert math.isclose(r.r, want.loc[r.x, r.y], abs_tol=1e-12)


def test_gram(spark):
    z = pd.DataFrame({"a": [1.0, 2.0], "b": [3.0, -1.0]})
    assert np.allclose(gram(frame(spark, z), ["a", "b"]), z.to_numpy().T @ z.to_numpy())


def test_ranks_through_shuffle_join(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": np.where(rng.random(800) < 0.4, 0.0, rng.normal(size=800)), "b": rng.normal(size=800)})
    monkeypatch.setattr(correlation, "BROADCAST_ROWS", 0)
    got = correlation.spearman_pairs(frame(spark, pdf), [("a", "b")], small=0).first()
    assert math.isclose(got.rho, pdf.corr("spearman").loc["a", "b"], abs_tol=1e-12) and got.n == 800


def test_long_columns_are_ranked_by_one_shuffle_each(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a = np.where(rng.random(900) < 0.4, 0.0, rng.normal(size=900))
    b, c = np.round(rng.normal(size=900), 1), rng.normal(size=900) + a
    a[::9], b[:4], c[::7] = -0.0, [np.inf, np.inf, -np.inf, np.inf], np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "d": np.arange(900) % 3.0})
    monkeypatch.setattr(correlation, "BROADCAST_ROWS", 10)
    df = frame(spark, pdf).repartition(3)
    found = correlation.spearman_all_pairs(df, list("abcd"))
    for r in found.collect():
        both = pdf[[r.x, r.y]].dropna()
        want = np.corrcoef(both[r.x].rank(), both[r.y].rank())[0, 1]
        assert math.isclose(r.r, want, abs_tol=1e-12) and r.n == len(both), (r.x, r.y)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # a and b on all rows, then on those that have c, and c; d has three values.
    assert sorted(re.findall(r"Exchange hashpartitioning\(\S*?(\w)__slice", plan)) == list("aabbc") and "_salt" not in plan


def test_line_fit(spark):
    x = np.arange(10.0)
    y = 3 * x + np.sin(x)
    got = correlation.line_fit(frame(spark, pd.DataFrame({"x": x, "y": y})), "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    e = y - slope * x - intercept
    assert math.isclose(got.slope, slope) and math.isclose(got.intercept, intercept)
    assert math.isclose(got.std_err, math.sqrt(e @ e / 8 / ((x - x.mean()) ** 2).sum()))
