"""Columnar JSON payloads: equal-length arrays unnested into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from isobar.sources.hive import stamp_load
from isobar.sources.schemas import payload_schema


def parse_payload(df: DataFrame, body: str, measures: Sequence[str], time: str = "time", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., payload) with the document typed."""
    return df.select(*keep, F.from_json(body, payload_schema(measures, time)).alias("payload"))


def unnest_payload(
    parsed: DataFrame,
    measures: Sequence[str],
    time: str = "time",
    keep: Sequence[str] = (),
    source_year: int | None = None,
    time_format: str | None = None,
) -> DataFrame:
    """One row per array position, time renamed to ``timestamp`` and read as UTC."""
    arrays = [F.col(f"payload.hourly.{c}").alias(c) for c in (time, *measures)]
    rows = parsed.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("r")).select(*keep, "r.*")
    at = F.to_timestamp(F.col(time), time_format) if time_format else F.to_timestamp(F.col(time))
    stamped = rows.withColumn("timestamp", at).select(*keep, "timestamp", *measures)
    return stamp_load(stamped, source_year)
