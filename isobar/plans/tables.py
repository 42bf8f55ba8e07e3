"""The given tables in their roles of observation facts and station dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isobar.operators.joins import join_checked
from isobar.plans.registry import TIE_SHIFT

# SQL twin of the views below; DuckDB runs it over the same files.
_VIEWS = """
obs AS (
  SELECT l_suppkey AS station_id, l_orderkey AS order_id, l_linenumber AS line_no,
         l_shipdate + to_hours(l_linenumber) AS ts,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(day(l_shipdate) AS INTEGER) AS day, CAST(l_linenumber AS INTEGER) AS hour,
         l_quantity AS temperature, l_discount AS rain, l_tax AS wind, l_extendedprice AS pressure,
         CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS humidity
  FROM lineitem),
stations AS (
  SELECT s_suppkey AS station_id, s_name AS name, CAST(s_nationkey AS DOUBLE) AS latitude,
         CAST(n_regionkey AS DOUBLE) AS longitude, s_acctbal AS elevation_m,
         r_name AS region, n_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def with_views(body: str, more: str = "") -> str:
    return f"WITH {_VIEWS}{', ' + more if more else ''} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hourly facts: supplier = station, ship date plus line number = hour."""
    li = table(spark, sf_dir, "lineitem")
    ts = (F.col("l_shipdate") + F.make_interval(hours=F.col("l_linenumber"))).cast("timestamp")
    return li.select(
        F.col("l_suppkey").alias("station_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        ts.alias("ts"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.dayofmonth("l_shipdate").alias("day"),
        F.col("l_linenumber").cast("int").alias("hour"),
        F.col("l_quantity").alias("temperature"),
        F.col("l_discount").alias("rain"),
        F.col("l_tax").alias("wind"),
        F.col("l_extendedprice").alias("pressure"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("humidity"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation and region as the station dimension."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    places = join_checked(nation, region, "n_regionkey", "inner")
    full = join_checked(table(spark, sf_dir, "supplier"), places, "s_nationkey", "inner")
    return full.select(
        F.col("s_suppkey").alias("station_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("double").alias("latitude"),
        F.col("n_regionkey").cast("double").alias("longitude"),
        F.col("s_acctbal").alias("elevation_m"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their station's constants."""
    return join_checked(observations(spark, sf_dir), stations(spark, sf_dir), "station_id")


def rd(col, digits: int = 6) -> Column:
    """Half-away-from-zero rounding just off the ties, as in ``registry.off_ties``; no -0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + F.lit(TIE_SHIFT * 10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rd(n, digits) for n in names})


def stamp_text(col) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
