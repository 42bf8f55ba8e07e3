"""File inventories, schema drift, sidecars and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.plans.foundation import _orders_tree
from isobar.plans.registry import query
from isobar.plans.tables import rounded, table
from isobar.session import scratch_path
from isobar.sources import files, hive, payload, sidecar

_KEYS = ["status", "year"]
_ORDERS = """o AS (SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey, o_totalprice,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS billed FROM orders)"""


@query(
    "file_inventory",
    "S4 F11",
    f"""WITH {_ORDERS} SELECT status, CAST(year AS VARCHAR) AS year, count(*) AS n_rows, CAST(5 AS INTEGER) AS n_cols, true AS has_bytes
        FROM o GROUP BY ALL""",
)
def file_inventory(spark, sf_dir):
    """Rows, columns and bytes per partition from file footers alone."""
    feet = files.file_inventory(files.footers(_orders_tree(spark, sf_dir)), _KEYS)
    return feet.groupBy(*_KEYS).agg(
        F.sum("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), (F.min("file_size_bytes") > 0).alias("has_bytes")
    )


def _drifted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status where status O lost a column, gained two and retyped one."""
    o = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "drift-tree")
    plain = o.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("status"))
    hive.write_tree(plain.filter("status != 'O'"), root, ["status"])
    odd = o.filter("o_orderstatus = 'O'").select(
        "o_orderkey",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.lit("x").alias("note"),
        F.lit(1).alias("extra"),
        F.col("o_orderstatus").alias("status"),
    )
    hive.write_tree(odd, root, ["status"])
    return hive.read_tree(spark, root)


@query(
    "schema_consistency",
    "S5",
    """SELECT DISTINCT o_orderstatus AS status, CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS INTEGER) AS schema_id,
              CAST(CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 3 END AS INTEGER) AS n_columns FROM orders""",
)
def schema_consistency(spark, sf_dir):
    """Schema id per file, widest schema first."""
    feet = files.footers(_drifted_tree(spark, sf_dir))
    return files.schema_consistency(feet, ["status"]).select("status", "schema_id", "n_columns").distinct()


@query(
    "schema_diff",
    "S6 F13 U5",
    """SELECT DISTINCT o_orderstatus AS status, 'o_custkey' AS missing_cols, 'extra;note' AS extra_cols, 'o_totalprice' AS dtype_mismatch
       FROM orders WHERE o_orderstatus = 'O'""",
)
def schema_diff(spark, sf_dir):
    """Missing, extra and retyped columns against the most common schema."""
    feet = files.footers(_drifted_tree(spark, sf_dir))
    return files.schema_diffs(feet, ["status"]).drop("path").distinct()


@query("shared_columns", "U5", """SELECT unnest(['o_orderkey', 'o_totalprice']) AS "column" FROM (SELECT count(*) FROM orders)""")
def shared_columns(spark, sf_dir):
    """Columns every file has."""
    return files.shared_columns(files.footers(_drifted_tree(spark, sf_dir))).select("column")


def _sidecars(spark: SparkSession, tree: DataFrame) -> DataFrame:
    grid = F.struct(F.lit(6.5).alias("latitude"), F.lit(80.0).alias("longitude"))
    units = {"o_totalprice": "USD", "billed": "USD"}
    return sidecar.build_sidecars(tree, _KEYS, ["o_totalprice", "billed"], units, grid, "orders")


@query(
    "sidecar_build",
    "S11 P7",
    f"""WITH {_ORDERS} SELECT status, year, count(*) AS hours, count(*) - count(billed) AS billed_gaps, count(*) - count(o_totalprice) AS price_gaps,
        'USD' AS unit FROM o GROUP BY ALL""",
)
def sidecar_build(spark, sf_dir):
    """Per-partition metadata built from the data, written as JSON and read back."""
    built = _sidecars(spark, _orders_tree(spark, sf_dir))
    path = scratch_path(spark, "sidecars")
    sidecar.write_sidecars(built, path, _KEYS)
    schema = "hours long, model string, hourly_units map<string,string>, grid struct<latitude:double,longitude:double>, null_counts map<string,long>"
    back = spark.read.text(path).select(*_KEYS, F.from_json("value", schema).alias("d"))
    return back.select(
        *_KEYS,
        "d.hours",
        F.col("d.null_counts")["billed"].alias("billed_gaps"),
        F.col("d.null_counts")["o_totalprice"].alias("price_gaps"),
        F.col("d.hourly_units")["billed"].alias("unit"),
    )


def _tree_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An orders tree with a provenance document in each partition.

    The documents of 1999 claim one row too many, those of status F two gaps too many.
    """
    root = scratch_path(spark, "orders-tree")
    tree = _orders_tree(spark, sf_dir, root)
    built = _sidecars(spark, tree)
    hours = F.col("hours") + F.when(F.col("year") == 1999, 1).otherwise(0)
    extra = F.when(F.col("status") == "F", 2).otherwise(0)
    request = F.struct(F.col("status").alias("location_id"), F.col("year"), hours.alias("hours"))
    counts = F.transform_values("null_counts", lambda k, v: v + F.when(k == "billed", extra).otherwise(0))
    body = F.to_json(
        F.struct(request.alias("request"), "model", "hourly_units", "grid", counts.alias("null_counts"))
    )
    sidecar.place_documents(spark, root, built.select(*_KEYS, body.alias("body")), _KEYS)
    return tree


@query(
    "sidecar_flatten",
    "S7 F12 F11",
    f"""WITH {_ORDERS} SELECT status, CAST(year AS VARCHAR) AS year, 'orders' AS model,
               '{{"location_id":"' || status || '","year":' || year || ',"hours":' || (n + CASE WHEN year = 1999 THEN 1 ELSE 0 END) || '}}' AS request,
               '{{"o_totalprice":"USD","billed":"USD"}}' AS hourly_units
        FROM (SELECT status, year, count(*) AS n FROM o GROUP BY ALL)""",
)
def sidecar_flatten(spark, sf_dir):
    """Nested documents flattened to one row per partition."""
    docs = sidecar.read_documents(sidecar.sidecar_paths(_tree_with_documents(spark, sf_dir)))
    flat = sidecar.flatten_sidecars(sidecar.parse_sidecars(docs, _KEYS), _KEYS)
    return flat.select(*_KEYS, "model", "request", "hourly_units")


@query(
    "sidecar_reconcile",
    "S8",
    f"""WITH {_ORDERS}, c AS (SELECT status, CAST(year AS VARCHAR) AS year, count(*) AS n, count(*) - count(billed) AS g FROM o GROUP BY ALL)
        SELECT status, year, 'hours' AS item, n + 1 AS documented, n AS actual FROM c WHERE year = '1999' UNION ALL
        SELECT status, year, 'billed', g + 2, g FROM c WHERE status = 'F'""",
)
def sidecar_reconcile(spark, sf_dir):
    """Documented row and null counts that disagree with the data."""
    tree = _tree_with_documents(spark, sf_dir)
    parsed = sidecar.parse_sidecars(sidecar.read_documents(sidecar.sidecar_paths(tree)), _KEYS)
    return sidecar.reconcile(parsed, tree, _KEYS, ["o_totalprice", "billed"])


@query(
    "payload_unnest",
    "S9 F1 F12 P2 P10",
    """SELECT vec_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts,
              round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS value, CAST(2024 AS BIGINT) AS source_year
       FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)""",
)
def payload_unnest(spark, sf_dir):
    """Columnar JSON documents (arrays of equal length) turned into rows."""
    vec = table(spark, sf_dir, "embeddings")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    times = F.transform(
        F.sequence(F.lit(0), F.size("embedding") - 1),
        lambda i: F.date_format(start + F.make_interval(hours=i), "yyyy-MM-dd'T'HH:mm"),
    )
    hourly = F.struct(times.alias("time"), F.col("embedding").cast("array<double>").alias("value"))
    body = F.to_json(F.struct(hourly.alias("hourly"), F.lit("UTC").alias("timezone")))
    docs = vec.select("vec_id", body.alias("body"))
    parsed = payload.parse_payload(docs, "body", ["value"], keep=["vec_id"])
    rows = payload.unnest_payload(parsed, ["value"], keep=["vec_id"], source_year=2024, time_format="yyyy-MM-dd'T'HH:mm")
    out = rows.select("vec_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value", "source_year")
    return rounded(out, "value")


@query(
    "json_flatten",
    "F12 S7",
    """SELECT event_type, count(*) AS n_obs, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
              max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type""",
)
def json_flatten(spark, sf_dir):
    """JSON text parsed to a struct and serialised again before use."""
    ev = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    again = ev.select("event_type", F.from_json(F.to_json("p"), "k long").alias("p"))
    return again.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("p.k").alias("k_sum"), F.max("p.k").alias("k_max")
    )
