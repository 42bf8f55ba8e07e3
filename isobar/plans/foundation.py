"""Scans, joins, enrichment and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.functions.scalars import as_utc, calendar, fixed_text, half_even, path_key, range_label, season
from isobar.operators import joins, rollup
from isobar.plans.registry import query
from isobar.plans.tables import observations, placed, rd, rounded, stamp_text, stations, table, with_views
from isobar.session import scratch_path
from isobar.sources import hive

_SEASON_SQL = """CASE WHEN month IN (12, 1, 2) THEN 'Northeast Monsoon' WHEN month IN (3, 4) THEN 'First Inter-monsoon'
  WHEN month IN (5, 6, 7, 8, 9) THEN 'Southwest Monsoon' ELSE 'Second Inter-monsoon' END"""


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to customer and nation through checked joins."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"), "o_totalprice"
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    homes = joins.join_checked(customer, nation, "c_nationkey")
    return joins.join_checked(orders, homes, "c_custkey")


@query(
    "nation_year_means",
    "S1 S2 P1 P2 J1 F2 A18 O1",
    """SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) + 0.0 AS mean_price,
              round(avg(c_acctbal), 4) + 0.0 AS mean_balance, count(*) AS n_obs
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       GROUP BY ALL""",
)
def nation_year_means(spark, sf_dir):
    """Join to a dimension, then named means and counts by place and year, ordered."""
    df = orders_by_nation(spark, sf_dir)
    out = rollup.means_with_counts(df, ["n_name", "year"], {"mean_price": "o_totalprice", "mean_balance": "c_acctbal"})
    return rounded(out, "mean_price", "mean_balance", digits=4)


@query(
    "star_enrich",
    "S1 S2 J1 F1 F2 F3 P1 P2",
    with_views(
        f"""SELECT order_id, line_no, station_id, name, region, country, latitude, longitude, elevation_m,
                   strftime(ts, '%Y-%m-%d') AS date, year, month, day, hour, {_SEASON_SQL} AS season
            FROM obs LEFT JOIN stations USING (station_id)"""
    ),
)
def star_enrich(spark, sf_dir):
    """The denormalised table: facts, station constants, calendar parts and season."""
    df = calendar(placed(spark, sf_dir).withColumn("ts", as_utc("ts")), "ts")
    df = df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return df.select(
        "order_id", "line_no", "station_id", "name", "region", "country", "latitude", "longitude", "elevation_m",
        "date", "year", "month", "day", "hour", "season",
    )


@query(
    "partition_prune",
    "S1 S12 P3 A1",
    """SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_obs,
              round(sum(o_totalprice), 2) + 0.0 AS total
       FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 GROUP BY ALL""",
)
def partition_prune(spark, sf_dir):
    """Write a Hive tree, then read one (key, year) of it by path pruning."""
    tree = _orders_tree(spark, sf_dir)
    one = tree.filter((F.col("status") == "F") & (F.col("year") == 1997))
    sums = one.groupBy("status", "year").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("o_totalprice").alias("total"))
    return rounded(sums, "total", digits=2)


def _orders_tree(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    root = root or scratch_path(spark, "orders-tree")
    hive.write_tree(_orders_keyed(spark, sf_dir), root, ["status", "year"])
    return hive.read_tree(spark, root)


def _orders_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the partition keys (status, year), with gaps put in one measure."""
    o = table(spark, sf_dir, "orders")
    gap = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice"))
    return o.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_totalprice",
        gap.alias("billed"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"),
    )


@query("key_discovery", "S3 U4", "SELECT DISTINCT o_orderstatus AS status FROM orders")
def key_discovery(spark, sf_dir):
    """Which partition keys hold data."""
    return hive.discover_keys(_orders_tree(spark, sf_dir), "status")


@query(
    "join_many_to_one_report",
    "J2",
    """SELECT copies, count(*) AS n_keys FROM (SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1
       HAVING count(*) > 1) GROUP BY 1""",
)
def join_many_to_one_report(spark, sf_dir):
    """Keys that would break a many-to-one join, by how often they repeat."""
    bad = joins.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    return bad.groupBy("copies").agg(F.count(F.lit(1)).alias("n_keys"))


@query(
    "location_reference",
    "J3 P4 F15 O1 P1",
    with_views(
        """SELECT station_id, name, elevation_m, region, station_id IN (0, 1, 2, 3, 4, 5) AS is_original FROM stations
           WHERE station_id IN (SELECT l_suppkey FROM lineitem)"""
    ),
)
def location_reference(spark, sf_dir):
    """Stations that have data, flagged by a fixed list, by elevation."""
    ref = joins.location_reference(
        stations(spark, sf_dir), observations(spark, sf_dir), "station_id", [0, 1, 2, 3, 4, 5], "elevation_m"
    )
    return ref.select("station_id", "name", "elevation_m", "region", "is_original")


@query(
    "merge_report",
    "J4 P7 A12 A15 F16",
    with_views(
        """SELECT (SELECT count(*) FROM obs) AS rows_before_merge, count(*) AS rows_after_merge,
                  (SELECT count(*) FROM obs) - count(*) AS rows_lost,
                  count(*) - count(DISTINCT (station_id, ts)) AS duplicate_records_after_merge,
                  count(*) FILTER (latitude IS NULL) AS unmatched_rows,
                  count(DISTINCT station_id) AS n_locations, count(DISTINCT year) AS n_years,
                  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS date_min, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS date_max
           FROM obs LEFT JOIN stations USING (station_id)"""
    ),
)
def merge_report(spark, sf_dir):
    """Verification of the fact-to-station join."""
    obs = observations(spark, sf_dir)
    merged = joins.join_checked(obs, stations(spark, sf_dir), "station_id")
    report = joins.merge_report(obs, merged, "station_id", "ts", "latitude")
    return report.withColumns({c: stamp_text(c) for c in ("date_min", "date_max")})


@query(
    "attach_constants",
    "J5 A2",
    with_views(
        """SELECT station_id, month, round(avg(temperature), 6) + 0.0 AS temperature, min(elevation_m) AS elevation_m,
                  min(name) AS name FROM obs JOIN stations USING (station_id) GROUP BY station_id, month"""
    ),
)
def attach_constants(spark, sf_dir):
    """Monthly station means first, then the inner join to station constants."""
    monthly = rollup.group_means(observations(spark, sf_dir), ["station_id", "month"], ["temperature"])
    out = rollup.attach_constants(monthly, stations(spark, sf_dir), "station_id", ["elevation_m", "name"])
    return rounded(out, "temperature")


@query(
    "load_stamp",
    "P10 P2 F1 F16",
    """SELECT CAST(year(ts) AS BIGINT) AS source_year, event_type AS kind, count(*) AS n_obs, count(*) AS n_stamped
       FROM events GROUP BY ALL""",
)
def load_stamp(spark, sf_dir):
    """Rename, then add source year and load time."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("ts").alias("timestamp"))
    stamped = hive.stamp_load(ev)
    return stamped.groupBy("source_year", "kind").agg(
        F.count(F.lit(1)).alias("n_obs"), F.count("ingested_at").alias("n_stamped")
    )


@query(
    "partition_overwrite",
    "S10 P3 P10",
    """SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_obs,
              round(sum(CASE WHEN o_orderstatus = 'O' AND year(o_orderdate) = 1998 THEN 1.0 ELSE o_totalprice END), 2) + 0.0 AS total
       FROM orders GROUP BY ALL""",
)
def partition_overwrite(spark, sf_dir):
    """Rewrite one (key, year) of a tree twice; every other partition stays."""
    root = scratch_path(spark, "orders-tree")
    hive.write_tree(_orders_keyed(spark, sf_dir), root, ["status", "year"])
    again = _orders_keyed(spark, sf_dir).filter("status = 'O' AND year = 1998").withColumn("o_totalprice", F.lit(1.0))
    for _ in range(2):
        hive.write_tree(again, root, ["status", "year"])
    df = hive.read_tree(spark, root)
    out = df.groupBy("status", "year").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("o_totalprice").alias("total"))
    return rounded(out, "total", digits=2)


@query(
    "csv_round_trip",
    "S13 S12",
    """SELECT c_mktsegment, CAST(c_nationkey AS INTEGER) AS c_nationkey, count(*) AS n_obs,
              round(avg(c_acctbal), 6) + 0.0 AS mean_balance FROM customer GROUP BY ALL""",
)
def csv_round_trip(spark, sf_dir):
    """A result table written as CSV with header and read back typed."""
    means = rollup.means_with_counts(
        table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], {"mean_balance": "c_acctbal"}
    )
    path = scratch_path(spark, "result-csv")
    hive.write_csv(means, path, single=True)
    back = hive.read_csv(spark, path, "c_mktsegment string, c_nationkey int, mean_balance double, n_obs long")
    return rounded(back, "mean_balance")


@query(
    "scalar_labels",
    "F5 F10 F13 F14 F16 F17 F3",
    """SELECT p_partkey, printf('%s: %d mm, %.2f C', p_brand, p_size, p_retailprice) AS label,
              list_aggregate(list_sort([p_brand, p_type]), 'string_agg', ';') AS joined, '[0, 50]' AS valid_range,
              round(sqrt(p_retailprice), 6) + 0.0 AS root, CAST(p_retailprice AS BIGINT) AS whole,
              round_even(p_size / 8.0, 2) + 0.0 AS eighths,
              CASE WHEN p_size % 12 + 1 IN (12, 1, 2) THEN 'Northeast Monsoon' WHEN p_size % 12 + 1 IN (3, 4) THEN 'First Inter-monsoon'
                   WHEN p_size % 12 + 1 IN (5, 6, 7, 8, 9) THEN 'Southwest Monsoon' ELSE 'Second Inter-monsoon' END AS season
       FROM (SELECT p_partkey, p_brand, p_type, p_size, floor(p_retailprice) AS p_retailprice FROM part)""",
)
def scalar_labels(spark, sf_dir):
    """Text labels, list joins, casts, roots and half-even rounding."""
    part = table(spark, sf_dir, "part").withColumn("p_retailprice", F.floor("p_retailprice").cast("double"))
    return part.select(
        "p_partkey",
        fixed_text("%s: %d mm, %.2f C", F.col("p_brand"), F.col("p_size"), F.col("p_retailprice")).alias("label"),
        F.array_join(F.sort_array(F.array("p_brand", "p_type")), ";").alias("joined"),
        F.lit(range_label(0, 50)).alias("valid_range"),
        rd(F.sqrt("p_retailprice")).alias("root"),
        F.col("p_retailprice").cast("long").alias("whole"),
        (half_even(F.col("p_size") / F.lit(8.0), 2) + F.lit(0.0)).alias("eighths"),
        season(F.col("p_size") % 12 + 1).alias("season"),
    )


@query(
    "path_keys",
    "F11",
    """SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_obs FROM orders GROUP BY ALL""",
)
def path_keys(spark, sf_dir):
    """Partition keys parsed out of the file path instead of by discovery."""
    df = _orders_tree(spark, sf_dir)
    path = F.col("_metadata.file_path")
    keyed = df.select(path_key(path, "status").alias("status"), path_key(path, "year").cast("int").alias("year"))
    return keyed.groupBy("status", "year").agg(F.count(F.lit(1)).alias("n_obs"))
