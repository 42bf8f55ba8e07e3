"""Order statistics: the sliced path must equal the plain one and pandas."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from isobar.operators.ordered import (
    Histogram,
    exact_percentiles,
    histogram_of,
    lowest_per_group,
    previous_place,
    value_counts,
    value_ranks,
)


@pytest.fixture(scope="module")
def skewed():
    """Two thirds of the rows in one group, a third of them on one value, some nulls."""
    rng = np.random.default_rng(7)
    g = rng.choice(["hot", "a", "b", None], size=4000, p=[0.66, 0.2, 0.13, 0.01])
    v = np.where(rng.random(4000) < 0.33, 0.0, np.round(rng.normal(size=4000), 2))
    v[rng.random(4000) < 0.02] = np.nan
    return pd.DataFrame({"g": g, "v": v})


def as_spark(spark, pdf):
    rows = [tuple(None if x is None or x != x else x for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("cuts", [[], [-1.0, 0.0, 0.5], None])
@pytest.mark.parametrize("descending", [False, True])
def test_average_ranks(spark, skewed, cuts, descending):
    hist = histogram_of(value_counts(as_spark(spark, skewed), "v", ["g"]), "v", ["g"], small=0, slices=16)
    assert len(hist.cuts) > 4
    hist = hist if cuts is None else replace(hist, cuts=cuts)
    got = hist.ranks(descending).toPandas()
    clean = skewed.dropna()
    clean = clean.assign(avg_rank=clean.groupby("g")["v"].rank(ascending=not descending))
    want = clean.groupby(["g", "v"]).agg(avg_rank=("avg_rank", "first"), _c=("v", "size")).reset_index()
    both = got.merge(want, on=["g", "v"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want)
    assert (both.avg_rank == both.avg_rank_w).all() and (both["_c"] == both["_c_w"]).all()


@pytest.mark.parametrize("small", [0, 10**6])
def test_percentiles_match_pandas(spark, skewed, small):
    df = as_spark(spark, skewed)
    probs = {"p0": 0.0, "p10": 0.1, "p33": 1 / 3, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_percentiles(df, "v", probs, ["g"], small=small).toPandas().set_index("g").sort_index()
    want = skewed.dropna().groupby("g")["v"].quantile(list(probs.values())).unstack()
    assert np.allclose(got[list(probs)].to_numpy(), want.to_numpy(), atol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.lists(st.integers(-5, 5), max_size=3))
def test_percentiles_whatever_the_cuts(spark, values, cuts):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    hist = Histogram(value_counts(df, "v"), "v", (), sorted({float(c) for c in cuts}))
    row = hist.percentiles({"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert np.allclose([row.a, row.b, row.c], np.quantile(values, [0.25, 0.5, 0.9]))


@pytest.mark.parametrize("small", [0, 1, 7, 10**6])
def test_previous_place_whatever_the_blocks(spark, small):
    rng = np.random.default_rng(small)
    groups = {
        "steady": list(range(-500, 500, 5)),
        "burst": [-(2**60), *rng.integers(0, 40, 300).tolist(), 2**60 + 1, 2**60 + 3],
        "copies": [8] * 200 + [9],
        "one": [-3],
    }
    data = [(g, v) for g, values in groups.items() for v in values] + [(None, 1), ("one", None)]
    df = spark.createDataFrame(data, "g string, v long").repartition(4)
    got = sorted((r.g, r.v, r["_c"], r.previous) for r in previous_place(df, "v", ["g"], small).collect())
    want = []
    for g, values in sorted(groups.items()):
        places = sorted(set(values))
        want += [(g, v, values.count(v), before) for before, v in zip([None, *places], places)]
    assert got == want
    assert previous_place(df.limit(0), "v", ["g"], small).count() == 0


def test_lowest_per_group_is_exact(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("hot").alias("g"), F.col("id").alias("v"))
    got = lowest_per_group(df, ["g"], [F.col("v")], 10, F.xxhash64("v"), parts=7).toPandas()
    assert sorted(got[got.g == "x"].v) == list(range(0, 30, 3))
    assert sorted(got[got.g == "hot"].v) == [v for v in range(30) if v % 3][:10]


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert value_ranks(df, "v", ["g"]).count() == 0
    assert exact_percentiles(df, "v", {"m": 0.5}, ["g"]).count() == 0
