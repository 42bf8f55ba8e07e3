"""Small helpers shared by the text operators."""

from __future__ import annotations

import string
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from isobar.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def crc_of(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks.

    Task functions travel by value, so their own globals are new in every task.
    """
    return sys.modules.setdefault("_isobar_worker_store", types.ModuleType("store")).__dict__


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    return to_arrow_schema(kind)


def with_id(kind: DataType, rest: str) -> StructType:
    """Schema of a column ``id`` of any type, whatever its inner names, before those of ``rest``."""
    return StructType([StructField("id", kind), *StructType.fromDDL(rest).fields])


def quoted(name: str) -> str:
    """A column's name as ``F.col`` and ``select`` take it, dots and marks included."""
    return "`" + name.replace("`", "``") + "`"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, so later reads prune columns. It
    outlives lost executors because every executor reaches the shared folder.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Hand texts to tasks in batches of so many rows while the jobs inside run.

    A batch is held by the executor and by its Python worker at once, whole.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of text, or one longer row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for at, n in enumerate(sizes):
            if at > start and size + n > limit:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
