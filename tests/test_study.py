"""The whole study on a small generated tree, end to end."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from isobar.operators import models
from isobar.plans import constants, study
from isobar.sources import hive, sidecar
from isobar.sources.schemas import LOCATION, MEASURES

# Id, name, latitude, longitude, elevation.
PLACES = [
    ("lk_galle", "Galle", 6.0535, 80.221, 3.0),
    ("lk_colombo", "Colombo", 6.9271, 79.8612, 9.0),
    ("lk_jaffna", "Jaffna", 9.6615, 80.0255, 9.0),
    ("lk_kandy", "Kandy", 7.2906, 80.6337, 499.0),
    ("lk_badulla", "Badulla", 6.9934, 81.055, 661.0),
    ("lk_nuwara_eliya", "Nuwara Eliya", 6.9497, 80.7891, 1888.0),
]
ORIGINAL = ["lk_jaffna", "lk_colombo", "lk_galle"]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("study"))
    rows = [(i, n, "LK", "South Asia", la, lo, h, "LK", "UTC") for i, n, la, lo, h in PLACES]
    rows.append(("xx_none", "Nowhere", "XX", "None", 0.0, 0.0, 0.0, "XX", "UTC"))
    locations = spark.createDataFrame(rows, LOCATION)
    locations.write.parquet(f"{base}/locations.parquet")
    steps = spark.range(2 * 365 * 4 + 4).select((F.lit(1704067200) + F.col("id") * 21600).alias("epoch"))
    ts = F.timestamp_seconds("epoch")
    warm = 28 - F.col("elevation_m") / 150 + 2 * F.sin(F.month(ts) / 2) + 3 * F.sin(F.hour(ts) / 4) + F.randn(1)
    special = {
        "temperature_2m": F.round(warm, 1),
        "precipitation": F.greatest(F.lit(0.0), F.round(F.randn(2), 1)),
        "snowfall": F.lit(0.0),
        "snow_depth": F.lit(0.0),
        "pressure_msl": F.round(1009 + F.randn(3), 1),
        "surface_pressure": F.round(1005 + F.randn(4), 1),
        "boundary_layer_height": F.when(F.month(ts) > 6, F.round(F.rand(5) * 100, 1)),
    }
    measures = [special.get(m, F.round(F.rand(10 + i) * 50, 1)).alias(m) for i, m in enumerate(MEASURES)]
    obs = steps.join(locations.filter("location_id != 'xx_none'")).select(
        ts.alias("timestamp"), *measures, F.year(ts).cast("long").alias("source_year"),
        F.current_timestamp().alias("ingested_at"), "location_id", F.year(ts).alias("year"),
    )
    root = f"{base}/weather"
    hive.write_tree(obs, root, ["location_id", "year"])
    tree = hive.read_observations(spark, root)
    meta = sidecar.build_sidecars(
        tree, ["location_id", "year"], ["temperature_2m", "boundary_layer_height"], {"temperature_2m": "C"},
        F.struct(F.lit(6.0).alias("latitude")), "m",
    )
    request = F.struct("location_id", "year", "hours")
    body = F.to_json(F.struct(request.alias("request"), "model", "hourly_units", "grid", "null_counts"))
    sidecar.place_documents(spark, root, meta.select("location_id", "year", body.alias("body")), ["location_id", "year"])
    out = f"{base}/out"
    names = study.write_study(
        spark, root, f"{base}/locations.parquet", out, ORIGINAL, 2024, 2025,
        sizes=models.Sizes(forest_trees=3, forest_depth=4, boost_rounds=2, sampled_rounds=2),
        space={"numTrees": [2, 3], "maxDepth": [3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]},
        draws=2, folds=2,
    )
    return out, names


def read(out, name):
    (part,) = glob.glob(f"{out}/{name}/part-*.csv")
    with open(part) as f:
        return list(csv.DictReader(f))


def test_all_tables_are_written(written):
    out, names = written
    assert len(names) == len(set(names)) >= 60
    empty = {n for n in names if n != "map_features" and not read(out, n)}
    assert empty <= {"schema_diffs", "source_mismatches"} | {"temperature_2m"}


def test_merge_and_quality(written):
    out, _ = written
    (merge,) = read(out, "merge_summary")
    assert merge["rows_before_merge"] == merge["rows_after_merge"] == str(6 * 2924)
    assert merge["rows_lost"] == merge["duplicate_records_after_merge"] == merge["unmatched_rows"] == "0"
    gaps = {r["column"]: r for r in read(out, "missing_overall")}
    assert int(gaps["boundary_layer_height"]["missing_count"]) > 0 and gaps["temperature_2m"]["missing_count"] == "0"
    assert len(gaps) == 64
    assert {r["column"]: r["n_positive"] for r in read(out, "positive_counts")} == {"snowfall": "0", "snow_depth": "0"}
    assert len(read(out, "plausibility")) == len(constants.BOUNDS)
    assert [r["delta_seconds"] for r in read(out, "time_resolution")] == ["21600.0"]


def test_locations(written):
    out, _ = written
    ref = read(out, "location_reference")
    assert [r["location_id"] for r in ref][0] == "lk_galle" and len(ref) == 6
    assert {r["location_id"] for r in ref if r["is_original"] == "true"} == set(ORIGINAL)
    assert [r["location_id"] for r in read(out, "location_summary")][:3] == ORIGINAL
    assert len(read(out, "location_summary")) == 6
    groups = read(out, "elevation_groups")
    assert [g["elevation_group"] for g in groups] == ["Low", "Medium", "High"]
    assert float(groups[0]["mean_temp"]) > float(groups[2]["mean_temp"])


def test_inference(written):
    out, _ = written
    pairs = {(r["x"], r["y"]): r for r in read(out, "focused_pairs")}
    assert set(pairs) == set(constants.FOCUS_PAIRS)
    assert float(pairs[("elevation_m", "temperature_2m")]["pearson_r"]) < -0.8
    assert len(read(out, "pearson_matrix")) == len(read(out, "spearman_matrix")) == 12
    tests = {r["test"]: r for r in read(out, "hypothesis_tests")}
    assert len(tests) == 6 and tests["H1_temperature_by_location"]["conclusion"].startswith("REJECT")
    terms = [r["term"] for r in read(out, "coefficients_model3")]
    assert terms[0] == "Intercept" and terms[1] == "C(month)[T.2]" and terms[-1] == "year" and len(terms) == 16
    r2 = [float(r["R_squared"]) for r in read(out, "regression_comparison")]
    assert r2[0] <= r2[1] <= r2[2]


def test_models_and_map(written):
    out, _ = written
    models_ = {r["Model"]: float(r["RMSE"]) for r in read(out, "model_comparison")}
    assert len(models_) == 6 and min(models_, key=models_.get) != "Baseline (mean)"
    for name in ("feature_importance", "permutation_importance", "shapley_mean_abs"):
        table = read(out, name)
        assert len(table) == 8 and table[0]["feature"] in ("elevation_m", "latitude", "longitude", "hour_sin", "hour_cos")
    (part,) = glob.glob(f"{out}/map_features/part-*.txt")[:1]
    with open(part) as f:
        feature = json.loads(f.readline())
    assert feature["geometry"]["type"] == "Point" and feature["properties"]["fill_color"].startswith("#")
    assert os.path.isdir(f"{out}/analytical/location_id=lk_galle/year=2024")
