"""Provenance documents that sit beside each partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from isobar.functions.null_safe import missing
from isobar.functions.scalars import path_key
from isobar.sources.schemas import SIDECAR

SIDECAR_NAME = "_source.json"


def sidecar_paths(tree: DataFrame, name: str = SIDECAR_NAME) -> DataFrame:
    """One candidate path per partition folder of a Parquet tree.

    Folders come from the file index, not from a scan.
    """
    folders = sorted({f.rsplit("/", 1)[0] for f in tree.inputFiles()})
    rows = [(f"{folder}/{name}",) for folder in folders]
    spark = tree.sparkSession
    return spark.createDataFrame(rows, "path string").repartition(max(1, -(-len(rows) // 64)), "path")


def read_documents(paths: DataFrame) -> DataFrame:
    """(path, body) of every document that exists.

    Spark's own readers skip names that start with an underscore, so tasks open the
    files themselves.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                fs, inner = pafs.FileSystem.from_uri(path)
                if fs.get_file_info(inner).is_file:
                    with fs.open_input_stream(inner) as handle:
                        rows.append((path, handle.read().decode("utf-8")))
            yield pd.DataFrame(rows, columns=["path", "body"])

    return paths.mapInPandas(read, "path string, body string")


def parse_sidecars(documents: DataFrame, keys: Sequence[str] = ("location_id", "year")) -> DataFrame:
    """One typed row per document with its partition keys."""
    doc = F.from_json("body", SIDECAR).alias("d")
    return documents.select(*[path_key(F.col("path"), k).alias(k) for k in keys], doc).select(*keys, "d.*")


def flatten_sidecars(parsed: DataFrame, keys: Sequence[str] = ("location_id", "year")) -> DataFrame:
    """Nested parts back as JSON text, plain ones as they are."""
    nested = ("request", "hourly_units", "grid", "null_counts")
    plain = ("model", "sha256", "downloaded_at")
    return parsed.select(*keys, *[F.to_json(c).alias(c) for c in nested], *plain)


def build_sidecars(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], units: dict[str, str], grid: Column, model: str
) -> DataFrame:
    """(keys..., hours, model, hourly_units, grid, null_counts) from the data itself."""
    gaps = [F.count_if(missing(df, m)) for m in measures]
    names = F.array(*[F.lit(m) for m in measures])
    unit_map = F.create_map(*[F.lit(x) for item in units.items() for x in item])
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"), F.map_from_arrays(names, F.array(*gaps)).alias("null_counts")
    )
    return per.select(
        *keys, "hours", F.lit(model).alias("model"), unit_map.alias("hourly_units"), grid.alias("grid"), "null_counts"
    )


def write_sidecars(sidecars: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One JSON document per line below ``key=value`` folders, under a readable name."""
    body = F.to_json(F.struct(*[c for c in sidecars.columns if c not in keys])).alias("value")
    sidecars.select(*keys, body).write.mode("overwrite").partitionBy(*keys).text(path)


def place_documents(spark: SparkSession, root: str, documents: DataFrame, keys: Sequence[str], name: str = SIDECAR_NAME) -> None:
    """Write (keys..., body) documents as ``name`` inside existing partition folders."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                folder = "/".join(f"{k}={getattr(row, k)}" for k in keys)
                fs, inner = pafs.FileSystem.from_uri(f"{root}/{folder}/{name}")
                with fs.open_output_stream(inner) as handle:
                    handle.write(row.body.encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    documents.select(*keys, "body").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def reconcile(parsed: DataFrame, df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sidecar row and null counts that disagree with the data.

    (keys..., item, documented, actual); ``item`` is ``hours`` or a measure name.
    """
    text_keys = [F.col(k).cast("string").alias(k) for k in keys]
    said = F.map_concat(F.create_map(F.lit("hours"), F.col("request.hours")), F.col("null_counts"))
    told = parsed.select(*text_keys, F.explode(said).alias("item", "documented"))
    items = [F.struct(F.lit("hours").alias("item"), F.count(F.lit(1)).alias("actual"))]
    items += [F.struct(F.lit(m).alias("item"), F.count_if(missing(df, m)).alias("actual")) for m in measures]
    seen = df.groupBy(*text_keys).agg(F.array(*items).alias("a")).select(*keys, F.explode("a").alias("r"))
    seen = seen.select(*keys, "r.item", "r.actual")
    both = told.join(seen, [*keys, "item"], "full_outer")
    return both.filter(~F.col("documented").eqNullSafe(F.col("actual")))
