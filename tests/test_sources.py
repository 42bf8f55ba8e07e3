"""Trees, footers, sidecars and payloads on small files."""

import datetime as dt
import json
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from isobar.session import scratch_path, shared_root
from isobar.sources import files, hive, payload, schemas, sidecar


def put(root, key, year, columns):
    folder = os.path.join(root, f"location_id={key}", f"year={year}")
    os.makedirs(folder)
    pq.write_table(pa.table(columns), os.path.join(folder, "weather.parquet"))


@pytest.fixture(scope="module")
def drift(tmp_path_factory):
    """Three usual files, one without a column, one retyped, one with an extra column."""
    root = str(tmp_path_factory.mktemp("tree"))
    f = pa.float64()
    usual = {"t": pa.array([1.0, None], f), "u": pa.array([1.0, 2.0], f)}
    for year in (2020, 2021, 2022):
        put(root, "a", year, usual)
    put(root, "b", 2020, {"t": usual["t"]})
    put(root, "b", 2021, {"t": pa.array([1, 2], pa.int64()), "u": usual["u"]})
    put(root, "b", 2022, {**usual, "w": usual["u"], "v": usual["u"]})
    return root


def test_inventory_and_schema_reports(spark, drift):
    feet = files.footers(hive.read_tree(spark, drift, "t double, u double, location_id string, year int"))
    inventory = files.file_inventory(feet, ["location_id", "year"]).collect()
    assert [(r.location_id, r.year, r.n_rows, r.n_cols) for r in inventory] == [
        ("a", "2020", 2, 2),
        ("a", "2021", 2, 2),
        ("a", "2022", 2, 2),
        ("b", "2020", 2, 1),
        ("b", "2021", 2, 2),
        ("b", "2022", 2, 4),
    ]
    assert all(r.file_size_bytes == os.path.getsize(r.path.removeprefix("file://")) for r in inventory)
    ids = {(r.location_id, r.year): (r.schema_id, r.n_columns) for r in files.schema_consistency(feet, ["location_id", "year"]).collect()}
    assert ids[("b", "2022")] == (0, 4) and ids[("b", "2020")] == (3, 1)
    assert ids[("a", "2020")] == ids[("a", "2022")] != ids[("b", "2021")]
    diffs = files.schema_diffs(feet, ["location_id", "year"]).collect()
    assert [(r.year, r.missing_cols, r.extra_cols, r.dtype_mismatch) for r in diffs] == [
        ("2020", "u", "", ""),
        ("2021", "", "", "t"),
        ("2022", "", "v;w", ""),
    ]
    assert [r.column for r in files.shared_columns(feet).collect()] == ["t"]


def test_pruning_reaches_the_scan(spark, drift):
    tree = hive.read_tree(spark, drift, "t double, u double, location_id string, year int")
    plan = tree.filter("location_id = 'a' AND year = 2021 AND t > 0").select("t")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(location_id" in plan and "GreaterThan(t,0.0)" in plan
    assert "ReadSchema: struct<t:double>" in plan
    assert sorted(r[0] for r in hive.discover_keys(tree).collect()) == ["a", "b"]


def test_overwrite_replaces_only_its_partition(spark):
    root = scratch_path(spark, "tree")
    df = spark.createDataFrame([("a", 2020, 1), ("a", 2021, 2), ("b", 2020, 3)], "location_id string, year int, v int")
    hive.write_tree(df, root, ["location_id", "year"])
    for _ in range(2):
        hive.write_tree(df.filter("year = 2021").withColumn("v", F.lit(9)), root, ["location_id", "year"])
    got = sorted((r.location_id, r.year, r.v) for r in hive.read_tree(spark, root).collect())
    assert got == [("a", 2020, 1), ("a", 2021, 9), ("b", 2020, 3)]


def test_scratch_is_below_the_configured_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_root(spark) + "/x-")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_root(spark) == configured.rstrip("/")


def test_nanosecond_files(spark, tmp_path):
    path = str(tmp_path / "ns.parquet")
    stamps = pd.to_datetime(["2024-01-01 00:00:00", "2024-06-01 12:30:00"], utc=True)
    pq.write_table(pa.table({"timestamp": pa.array(stamps, pa.timestamp("ns", "UTC"))}), path, version="2.6")
    got = [r[0] for r in hive.read_nanosecond_parquet(spark, path, ["timestamp"]).collect()]
    assert got == [dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1, 12, 30)]


def test_sidecars_round_trip_and_reconcile(spark, drift):
    doc = {
        "request": {"location_id": "a", "year": 2020, "start": "2020-01-01", "end": "2020-12-31", "hours": 2},
        "model": "m",
        "hourly_units": {"t": "C"},
        "grid": {"latitude": 6.0, "longitude": 80.0, "elevation": 3.0, "timezone": "UTC"},
        "null_counts": {"t": 1, "u": 5},
    }
    with open(f"{drift}/location_id=a/year=2020/_source.json", "w") as f:
        json.dump(doc, f, indent=2)
    tree = hive.read_tree(spark, drift, "t double, u double, location_id string, year int").filter("location_id = 'a' AND year = 2020")
    every = hive.read_tree(spark, drift, "t double, u double, location_id string, year int")
    parsed = sidecar.parse_sidecars(sidecar.read_documents(sidecar.sidecar_paths(every)))
    row = parsed.first()
    assert parsed.count() == 1 and row.request.hours == 2 and row.null_counts == {"t": 1, "u": 5}
    flat = sidecar.flatten_sidecars(parsed).first()
    assert json.loads(flat.hourly_units) == {"t": "C"} and flat.model == "m" and flat.location_id == "a"
    bad = sidecar.reconcile(parsed, tree, ["location_id", "year"], ["t", "u"]).collect()
    assert [(r.item, r.documented, r.actual) for r in bad] == [("u", 5, 0)]


def test_payload_with_gaps(spark):
    body = json.dumps({"hourly": {"time": ["2024-02-29T23:00", "2024-03-01T00:00"], "t": [1.5, None], "u": [None, 2.0]}})
    docs = spark.createDataFrame([("a", body)], "k string, body string")
    rows = payload.unnest_payload(payload.parse_payload(docs, "body", ["t", "u"], keep=["k"]), ["t", "u"], keep=["k"], source_year=2024).collect()
    assert [(r.k, r.timestamp, r.t, r.u, r.source_year) for r in rows] == [
        ("a", dt.datetime(2024, 2, 29, 23), 1.5, None, 2024),
        ("a", dt.datetime(2024, 3, 1), None, 2.0, 2024),
    ]
    assert all(r.ingested_at is not None for r in rows)


def test_declared_schema():
    assert len(schemas.MEASURES) == 47 and len(schemas.OBSERVATION) == 52
    assert schemas.time_column(["x", "timestamp", "date"]) == "date" and schemas.time_column(["x"]) is None
