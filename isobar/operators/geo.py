"""Map-ready tables from location aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from isobar.functions.null_safe import safe_corr, without_nan
from isobar.functions.scalars import half_even, heat_colour, marker_radius
from isobar.operators.ordered import SMALL_DISTINCT, exact_percentiles


def map_centre(agg: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return agg.agg(F.avg(lat).alias("centre_lat"), F.avg(lon).alias("centre_lon"))


def marker_table(agg: DataFrame, value: str, label: str, popup: Column, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Position, radius, fill colour, popup text and tooltip per location."""
    span = agg.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    return agg.select(
        F.col(label).alias("tooltip"),
        F.col(lat).alias("lat"),
        F.col(lon).alias("lon"),
        marker_radius(F.col(value), span["lo"]).alias("radius"),
        heat_colour(F.col(value), span["lo"], span["hi"]).alias("fill_color"),
        popup.alias("popup"),
    )


def geojson_features(markers: DataFrame, properties: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON point feature per row, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")
    )
    return markers.select(F.to_json(feature).alias("feature"))


def gradients(agg: DataFrame, axes: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Slope and r-squared of each location measure along each axis."""
    fits = []
    for axis in axes:
        for m in measures:
            r = safe_corr(axis, m)
            fits.append(
                F.struct(
                    F.lit(axis).alias("axis"),
                    F.lit(m).alias("measure"),
                    F.regr_slope(m, axis).alias("slope"),
                    (r * r).alias("r_squared"),
                )
            )
    return agg.agg(F.array(*fits).alias("f")).select(F.explode("f").alias("g")).select("g.*")


def span_gate(agg: DataFrame, height: str, minimum: float = 100.0) -> DataFrame:
    """Whether the heights spread far enough to speak of an elevation effect."""
    agg = without_nan(agg, [height])
    span = F.max(height) - F.min(height)
    return agg.agg(
        F.count(F.lit(1)).alias("n_locations"),
        F.min(height).alias("lowest"),
        F.max(height).alias("highest"),
        span.alias("span"),
        F.count_distinct(height).alias("distinct_heights"),
        F.when(span < minimum, "insufficient").otherwise("sufficient").alias("status"),
    )


def tertile_labels(agg: DataFrame, height: str, small: int = SMALL_DISTINCT) -> DataFrame:
    """Append Low / Medium / High by interpolated thirds, right edge included."""
    agg = without_nan(agg, [height])
    thirds = exact_percentiles(agg, height, {"a": 1 / 3, "b": 2 / 3}, (), small)
    cut = thirds.select(F.struct("a", "b").alias("c")).scalar()
    h = F.col(height)
    label = F.when(h <= cut["a"], "Low").when(h <= cut["b"], "Medium").when(h.isNotNull(), "High")
    return agg.withColumn("elevation_group", label)


def tertile_means(agg: DataFrame, height: str, values: Sequence[str], digits: int = 2) -> DataFrame:
    """Mean of each value per tertile; all three labels appear, in order."""
    spark = agg.sparkSession
    labels = spark.createDataFrame([("Low", 0), ("Medium", 1), ("High", 2)], "elevation_group string, _at int")
    labelled = tertile_labels(without_nan(agg, values), height).filter(F.col("elevation_group").isNotNull())
    means = labelled.groupBy("elevation_group").agg(
        F.count(F.lit(1)).alias("n"), *[half_even(F.avg(v), digits).alias(v) for v in values]
    )
    out = labels.join(means, "elevation_group", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.orderBy("_at").drop("_at")
