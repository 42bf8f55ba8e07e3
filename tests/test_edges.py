"""Hand-made frames: nulls, ties, bounds, duplicates, gaps, guards."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from isobar.functions.null_safe import safe_corr, sample_skew
from isobar.functions.scalars import heat_colour, half_even, season
from isobar.operators import correlation, distribution, geo, joins, quality, rollup


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    data = [
        ("a", 2020, 1.0, 1.0),
        ("a", 2021, 2.0, None),
        ("b", 2020, None, 3.0),
        ("b", 2020, None, float("nan")),
        (None, 2020, 5.0, 5.0),
    ]
    return spark.createDataFrame(data, "k string, year int, x double, y double")


def test_null_groups_drop_out_and_empty_sums_are_zero(small):
    assert sorted(rows(rollup.count_by(small, "k"))) == [("a", 2), ("b", 2)]
    totals = {r.k: r.x for r in rollup.mean_of_totals(small, ["k"], "year", "x").collect()}
    assert totals == {"a": 1.5, "b": 0.0}


def test_missing_counts_nan_and_null(small):
    got = {r.column: (r.missing_count, r.missing_pct) for r in quality.missing_overall(small).collect()}
    assert got == {"k": (1, 20.0), "year": (0, 0.0), "x": (2, 40.0), "y": (2, 40.0)}
    assert {r.column for r in quality.with_any_missing(quality.missing_overall(small)).collect()} == {"k", "x", "y"}
    assert rows(quality.missing_by_group(small, "k", ["x", "y"])) == [("a", 0.0, 50.0), ("b", 100.0, 50.0)]


def test_bounds_are_closed_and_nulls_are_fine(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.01,), (-0.01,), (None,)], "v double")
    assert rows(quality.bounds_check(df, {"v": (0, 10), "absent": (0, 1)})) == [("v", "[0, 10]", 2, 40.0)]


def test_empty_table_reports(spark):
    df = spark.createDataFrame([], "k string, year int, v double")
    assert rows(quality.missing_overall(df, ["v"])) == [("v", 0, None)]
    assert rows(quality.bounds_check(df, {"v": (0, 1)})) == [("v", "[0, 1]", 0, None)]
    assert quality.duplicate_rows(df).first()[0] == 0
    assert rows(quality.table_profile(df, "k", "year")) == [(0, 0, 0, 3)]


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (2, None)], "k int, v int")
    assert rows(quality.duplicate_report(df, ["k"])) == [(1, 2)]


def test_repeated_dimension_key_raises(spark):
    fact = spark.createDataFrame([("a", 1), ("z", 2)], "k string, v int")
    dim = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, lat double")
    with pytest.raises(joins.ManyToOneError):
        joins.join_checked(fact, dim, "k")
    assert joins.join_checked(fact, dim, "k", validate=None).count() == 3


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain(spark, how):
    fact = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v")
    )
    dim = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = sorted(rows(fact.join(dim, "k", how).select("k", "v", "w")), key=str)
    hot = joins.hot_keys(fact, "k", 0.1)
    assert hot == [0]
    salted = joins.salted_join(fact, dim, "k", hot, how)
    assert sorted(rows(salted.select("k", "v", "w")), key=str) == plain
    big = joins.join_checked(fact, dim, "k", how, broadcast_rows=0)
    assert sorted(rows(big.select("k", "v", "w")), key=str) == plain


def test_merge_report_flags_each_fault(spark):
    t = dt.datetime(2020, 1, 1)
    fact = spark.createDataFrame([("a", t), ("a", t), ("z", t)], "k string, ts timestamp")
    dim = spark.createDataFrame([("a", 1.0)], "k string, lat double")
    merged = joins.join_checked(fact, dim, "k")
    r = joins.merge_report(fact, merged, "k", "ts", "lat").first()
    assert (r.rows_before_merge, r.rows_lost, r.duplicate_records_after_merge, r.unmatched_rows) == (3, 0, 1, 1)
    with pytest.raises(joins.MergeCheckError):
        joins.assert_merge(joins.merge_report(fact, merged, "k", "ts", "lat"))


def test_time_steps_stay_inside_a_station(spark):
    h = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)
    data = [("a", h(0)), ("a", h(1)), ("a", h(1)), ("a", h(3)), ("b", h(500)), ("b", h(501))]
    df = spark.createDataFrame(data, "k string, ts timestamp")
    for small in (0, 10**6):
        assert rows(quality.common_deltas(df, "k", "ts", small=small)) == [(3600.0, 2), (0.0, 1), (7200.0, 1)]


def test_annual_totals_by_own_and_global_years(spark):
    data = [("a", 2020, 10.0), ("a", 2021, 20.0), ("b", 2020, 6.0)]
    df = spark.createDataFrame(data, "k string, year int, rain double")
    for years, want in (("group", {"a": 15.0, "b": 6.0}), ("global", {"a": 15.0, "b": 3.0})):
        agg = rollup.location_aggregate(df, ["k"], {"m": "rain"}, {"total": "rain"}, years=years)
        assert {r.k: r.total for r in agg.collect()} == want
        assert {r.k: r.m for r in agg.collect()} == {"a": 15.0, "b": 6.0}


def test_rank_ties_and_missing_cell(spark):
    data = [("a", 2020, 3.0), ("b", 2020, 9.0), ("c", 2020, 9.0), ("a", 2021, 1.0)]
    df = spark.createDataFrame(data, "k string, year int, v double")
    got = {r.k: (r["2020"], r["2021"]) for r in rollup.rank_by_period(df, "k", "year", "v", [2020, 2021]).collect()}
    assert got == {"a": (3.0, 1.0), "b": (1.5, None), "c": (1.5, None)}
    with pytest.raises(rollup.DuplicateCellError):
        rollup.pivot_cells(df.unionAll(df), "k", "year", [2020], "v")


def test_key_order_keeps_unlisted_rows(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3)], "k string, v int")
    assert rows(rollup.in_key_order(df, "k", ["a", "no", "b"])) == [("a", 2), ("no", None), ("b", 1), ("z", 3)]


def test_top_rows_take_first_on_ties(spark):
    df = spark.createDataFrame([(3, 5.0), (1, 5.0), (2, 5.0), (4, None), (5, 1.0)], "k int, v double")
    assert rows(rollup.top_rows(df, "v", ["k", "v"], ["k"], 2)) == [(1, 5.0), (2, 5.0)]


def test_sample_is_reproducible(spark):
    df = spark.range(500).withColumn("v", F.rand(1))
    a = {r.id for r in rollup.seeded_sample(df.repartition(3), ["id"], 20).collect()}
    b = {r.id for r in rollup.seeded_sample(df.repartition(7), ["id"], 20).collect()}
    c = {r.id for r in rollup.seeded_sample(df, ["id"], 20, seed=1).collect()}
    assert a == b and a != c and len(a) == 20


def test_seasons_and_rounding(spark):
    months = spark.createDataFrame([(m,) for m in (12, 1, 2, 3, 5, 9, 10, None)], "m int")
    assert [r[0] for r in months.select(season(F.col("m"))).collect()] == [
        *["Northeast Monsoon"] * 3,
        "First Inter-monsoon",
        *["Southwest Monsoon"] * 2,
        "Second Inter-monsoon",
        None,
    ]
    assert spark.range(1).select(half_even(F.lit(0.125), 2)).first()[0] == 0.12


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 5.0, 7.0), (3.0, 1.0, 7.0)], "x double, y double, c double")
    r = df.agg(safe_corr("x", "c").alias("a"), safe_corr("c", "x").alias("b"), safe_corr("x", "y").alias("d")).first()
    assert r.a is None and r.b is None and math.isclose(r.d, -0.24019223070763068)
    pairs = {(p.x, p.y): p.r for p in correlation.pearson_pairs(df, ["x", "y", "c"]).collect()}
    assert pairs[("x", "c")] is None and math.isclose(pairs[("x", "y")], -0.24019223070763068)
    two = spark.createDataFrame([("m", 1.0, 2.0), ("m", 2.0, 5.0), ("m", 2.0, 5.5)], "g string, x double, y double")
    assert correlation.corr_by_group(two, "g", "x", "y").first().pearson_r is None
    assert correlation.line_fit(two, "x", "y").count() == 0
    assert distribution.fit_line(two, "x", "y").count() == 0


def test_pairwise_complete_correlation(spark):
    data = [(1.0, 1.0, 4.0), (2.0, None, 1.0), (3.0, 2.0, None), (4.0, 7.0, 2.0), (None, 3.0, 3.0), (6.0, 5.0, 9.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    pdf = df.toPandas()
    for method, run in (("pearson", correlation.pearson_pairs), ("spearman", correlation.spearman_all_pairs)):
        want = pdf.corr(method)
        for r in run(df, ["a", "b", "c"]).collect():
            assert math.isclose(r.r, want.loc[r.x, r.y], abs_tol=1e-12), (method, r)


def test_skew_of_constant_and_short_columns(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 1.0), ("c", 1.0), ("s", 1.0), ("s", 2.0)], "g string, v double")
    assert {r.g: r.s for r in df.groupBy("g").agg(sample_skew("v").alias("s")).collect()} == {"c": None, "s": None}


def test_histogram_closes_last_bin_and_survives_constants(spark):
    df = spark.createDataFrame([(0.0, 4.0), (5.0, 4.0), (10.0, 4.0)], "v double, c double")
    got = {(r.variable, r.bin): r.n for r in distribution.histogram(df, ["v", "c"], 2).collect()}
    assert got == {("v", 0): 1, ("v", 1): 2, ("c", 0): 3}


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select(F.randn(3).alias("v"))
    d = distribution.density(df, ["v"]).orderBy("x").toPandas()
    area = ((d.density[1:].to_numpy() + d.density[:-1].to_numpy()) / 2 * d.x.diff()[1:].to_numpy()).sum()
    assert 0.98 < area < 1.01


def test_tertiles_with_collapsed_edges(spark):
    ties = spark.createDataFrame([(v, v) for v in (3.0, 6.0, 9.0, 9.0, 9.0, 10.0)], "h double, v double")
    got = {r.elevation_group: (r.n, r.v) for r in geo.tertile_means(ties, "h", ["v"]).collect()}
    assert got == {"Low": (2, 4.5), "Medium": (3, 9.0), "High": (1, 10.0)}
    flat = spark.createDataFrame([(5.0, 1.0)] * 4, "h double, v double")
    got = {r.elevation_group: (r.n, r.v) for r in geo.tertile_means(flat, "h", ["v"]).collect()}
    assert got == {"Low": (4, 1.0), "Medium": (0, None), "High": (0, None)}


def test_span_gate(spark):
    near = spark.createDataFrame([(3.0,), (10.0,)], "h double")
    far = spark.createDataFrame([(3.0,), (1888.0,)], "h double")
    assert geo.span_gate(near, "h").first().status == "insufficient"
    assert geo.span_gate(far, "h").first().status == "sufficient"


def test_flat_colour_scale_is_blue(spark):
    got = spark.range(1).select(heat_colour(F.lit(4.0), F.lit(4.0), F.lit(4.0))).first()[0]
    assert got == "#0030ff"


def test_coverage_and_gaps(spark):
    t = dt.datetime(2019, 12, 31, 22)
    data = [("a", t + dt.timedelta(hours=n)) for n in (0, 1, 2, 4, 30)]
    df = spark.createDataFrame(data, "k string, ts timestamp").withColumn("year", F.year("ts"))
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {(r.k, r.year): (r.expected_hours, r.n_obs, r.present) for r in quality.coverage(keys, df, "k", "year", 2019, 2020).collect()}
    assert got == {
        ("a", 2019): (8760, 2, True),
        ("a", 2020): (8784, 3, True),
        ("b", 2019): (8760, 0, False),
        ("b", 2020): (8784, 0, False),
    }
    gaps = [r.hour_start for r in quality.hour_gaps(df, "k", "ts").orderBy("hour_start").collect()]
    assert gaps == [t + dt.timedelta(hours=n) for n in range(31) if n not in (0, 1, 2, 4, 30)]


def test_rolling_usage_crosses_blocks(spark):
    data = [("s", e, 1.0) for e in (10, 50, 70, 99, 100, 101, 161, 400)]
    df = spark.createDataFrame(data, "s string, e long, c double")
    want = {e: sum(1.0 for o in (10, 50, 70, 99, 100, 101, 161, 400) if e - 60 <= o <= e) for _, e, _ in data}
    got = {r.epoch: r.minute for r in quality.rolling_usage(df, "s", "e", "c", {"minute": 60}, block=100).collect()}
    assert got == want
