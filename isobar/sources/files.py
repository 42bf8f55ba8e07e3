"""File-level reports from Parquet footers: inventory, schema ids, schema diffs.

Footers hold row counts and column types, so none of these reads a data page. The
file list is spread over tasks; each task opens only the footers of its own files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.functions.scalars import path_key


def _each_file(files: Sequence[str], spark: SparkSession, per_task: int = 64) -> DataFrame:
    tasks = max(1, -(-len(files) // per_task))
    rows = spark.createDataFrame([(f,) for f in files], "path string")
    return rows.repartition(tasks, "path")


def footers(tree: DataFrame) -> DataFrame:
    """(path, n_rows, n_bytes, columns: array<struct<column, dtype>>) per data file."""
    schema = "path string, n_rows long, n_bytes long, columns array<struct<column:string,dtype:string>>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                fs, inner = pafs.FileSystem.from_uri(path)
                size = fs.get_file_info(inner).size
                with fs.open_input_file(inner) as handle:
                    parquet = pq.ParquetFile(handle)
                    kinds = [{"column": f.name, "dtype": str(f.type)} for f in parquet.schema_arrow]
                    rows.append((path, parquet.metadata.num_rows, size, kinds))
            yield pd.DataFrame(rows, columns=["path", "n_rows", "n_bytes", "columns"])

    return _each_file(tree.inputFiles(), tree.sparkSession).mapInPandas(read, schema)


def with_path_keys(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    return files.select(*[path_key(F.col("path"), k).alias(k) for k in keys], "*")


def file_inventory(feet: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, columns and bytes of every file with its partition keys."""
    return with_path_keys(feet, keys).select(
        *keys, "n_rows", F.size("columns").alias("n_cols"), F.col("n_bytes").alias("file_size_bytes"), "path"
    ).orderBy(*keys, "path")


def schema_ids(feet: DataFrame) -> DataFrame:
    """Distinct schemas, widest first: (schema, schema_id, n_columns, n_files)."""
    shape = F.array_sort("columns").alias("schema")
    kinds = feet.select(shape).groupBy("schema").agg(F.count(F.lit(1)).alias("n_files"))
    # Few schemas exist whatever the number of files, so numbering runs on the driver list.
    found = sorted(kinds.collect(), key=lambda r: (-len(r.schema), str(r.schema)))
    rows = [(r.schema, i, len(r.schema), r.n_files) for i, r in enumerate(found)]
    kind = "schema array<struct<column:string,dtype:string>>, schema_id int, n_columns int, n_files long"
    return feet.sparkSession.createDataFrame(rows, kind)


def schema_consistency(feet: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., path, schema_id, n_columns) per file."""
    ids = schema_ids(feet)
    files = with_path_keys(feet, keys).withColumn("schema", F.array_sort("columns"))
    return files.join(F.broadcast(ids), "schema").select(*keys, "path", "schema_id", "n_columns").orderBy(*keys, "path")


def schema_diffs(feet: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files that differ from the most common schema: missing, extra and retyped columns."""
    usual = schema_ids(feet).agg(F.max_by("schema", F.struct("n_files", -F.col("schema_id")))).scalar()
    both = with_path_keys(feet, keys).withColumn("usual", usual)

    def names(column: str):
        return F.transform(F.col(column), lambda f: f["column"])

    known = F.map_from_entries("usual")
    retyped = F.filter(
        F.col("columns"),
        lambda f: F.map_contains_key(known, f["column"]) & (F.element_at(known, f["column"]) != f["dtype"]),
    )

    def joined(array):
        return F.array_join(F.sort_array(array), ";")

    out = both.select(
        *keys,
        "path",
        joined(F.array_except(names("usual"), names("columns"))).alias("missing_cols"),
        joined(F.array_except(names("columns"), names("usual"))).alias("extra_cols"),
        joined(F.transform(retyped, lambda f: f["column"])).alias("dtype_mismatch"),
    )
    return out.filter("missing_cols != '' OR extra_cols != '' OR dtype_mismatch != ''").orderBy(*keys, "path")


def shared_columns(feet: DataFrame) -> DataFrame:
    """(column, n_files): columns present in every file."""
    n = feet.agg(F.count(F.lit(1))).scalar()
    each = feet.select(F.explode("columns").alias("c")).groupBy(F.col("c.column").alias("column"))
    return each.agg(F.count(F.lit(1)).alias("n_files")).filter(F.col("n_files") == n)


def column_types(df: DataFrame) -> DataFrame:
    """(column, dtype) of a table."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string")
