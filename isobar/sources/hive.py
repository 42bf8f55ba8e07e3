"""Hive-partitioned Parquet trees: read, discover, write, replace one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from isobar.sources.schemas import LOCATION, OBSERVATION


def read_tree(
    spark: SparkSession, root: str, schema: StructType | None = None, year_alias: str | None = "year_partition"
) -> DataFrame:
    """A ``key=value/`` Parquet tree; path keys become columns.

    With a schema no file is opened for inference. ``year`` is also offered under
    ``year_alias``.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(root)
    if year_alias and "year" in df.columns:
        df = df.withColumn(year_alias, F.col("year"))
    return df


def read_observations(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root, OBSERVATION)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATION).parquet(path)


def read_nanosecond_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet whose timestamps are in nanoseconds, which Spark reads only as longs."""
    before = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", "false")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        df = spark.read.parquet(path)
        df.schema
    finally:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", before)
    micros = {c: F.timestamp_micros(F.floor(F.col(c) / F.lit(1000)).cast("long")) for c in columns}
    return df.withColumns(micros)


def discover_keys(df: DataFrame, key: str = "location_id") -> DataFrame:
    """Partition keys that hold data. Only the path key is read, no data column."""
    return df.select(key).distinct()


def write_tree(df: DataFrame, root: str, keys: Sequence[str], rows_per_file: int = 5_000_000) -> None:
    """Write ``df`` as a tree, replacing only the partitions it holds.

    The rebalance hint groups rows by partition and splits a partition that is too
    large for one task, so hot stations are written by several tasks and small ones
    do not leave a file per task.
    """
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*keys)
        .parquet(root)
    )


def write_table(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Write one Parquet table, partitioned where keys are given."""
    if keys:
        write_tree(df, path, keys)
    else:
        df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header; ``single`` gathers a small result table into one file after it is computed."""
    out = df.repartition(1) if single else df
    out.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def stamp_load(df: DataFrame, source_year: int | None = None, ts: str = "timestamp") -> DataFrame:
    """Append ``source_year`` and the load time ``ingested_at``."""
    year = F.lit(source_year) if source_year is not None else F.year(ts)
    return df.withColumns({"source_year": year.cast("long"), "ingested_at": F.current_timestamp()})
