"""Declared schemas of the observation model."""

from __future__ import annotations

from pyspark.sql import types as T

# The hourly measures, in file order.
MEASURES = """
temperature_2m relative_humidity_2m dew_point_2m apparent_temperature precipitation rain snowfall snow_depth
weather_code pressure_msl surface_pressure cloud_cover cloud_cover_low cloud_cover_mid cloud_cover_high
et0_fao_evapotranspiration vapour_pressure_deficit wind_speed_10m wind_speed_100m wind_direction_10m
wind_direction_100m wind_gusts_10m soil_temperature_0_to_7cm soil_temperature_7_to_28cm
soil_temperature_28_to_100cm soil_temperature_100_to_255cm soil_moisture_0_to_7cm soil_moisture_7_to_28cm
soil_moisture_28_to_100cm soil_moisture_100_to_255cm boundary_layer_height wet_bulb_temperature_2m
total_column_integrated_water_vapour is_day sunshine_duration shortwave_radiation direct_radiation
diffuse_radiation direct_normal_irradiance global_tilted_irradiance terrestrial_radiation
shortwave_radiation_instant direct_radiation_instant diffuse_radiation_instant
direct_normal_irradiance_instant global_tilted_irradiance_instant terrestrial_radiation_instant
""".split()

TIME_NAMES = ("time", "date", "datetime", "timestamp")

OBSERVATION = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in MEASURES]
    + [T.StructField("source_year", T.LongType()), T.StructField("ingested_at", T.TimestampType())]
    + [T.StructField("location_id", T.StringType()), T.StructField("year", T.IntegerType())]
)

LOCATION = T.StructType(
    [
        T.StructField("location_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("elevation_m", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("timezone", T.StringType()),
    ]
)

SIDECAR = T.StructType(
    [
        T.StructField(
            "request",
            T.StructType(
                [
                    T.StructField("location_id", T.StringType()),
                    T.StructField("latitude", T.DoubleType()),
                    T.StructField("longitude", T.DoubleType()),
                    T.StructField("year", T.IntegerType()),
                    T.StructField("start", T.StringType()),
                    T.StructField("end", T.StringType()),
                    T.StructField("hours", T.LongType()),
                ]
            ),
        ),
        T.StructField("model", T.StringType()),
        T.StructField("hourly_units", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "grid",
            T.StructType(
                [
                    T.StructField("latitude", T.DoubleType()),
                    T.StructField("longitude", T.DoubleType()),
                    T.StructField("elevation", T.DoubleType()),
                    T.StructField("timezone", T.StringType()),
                ]
            ),
        ),
        T.StructField("null_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("sha256", T.StringType()),
        T.StructField("downloaded_at", T.StringType()),
    ]
)


def time_column(columns) -> str | None:
    """The first usual time column a table has."""
    return next((name for name in TIME_NAMES if name in columns), None)


def payload_schema(measures, time: str = "time") -> T.StructType:
    """A columnar JSON payload: equal-length arrays under ``hourly``."""
    arrays = [T.StructField(time, T.ArrayType(T.StringType()))]
    arrays += [T.StructField(m, T.ArrayType(T.DoubleType())) for m in measures]
    return T.StructType(
        [
            T.StructField("hourly", T.StructType(arrays)),
            T.StructField("hourly_units", T.MapType(T.StringType(), T.StringType())),
            T.StructField("latitude", T.DoubleType()),
            T.StructField("longitude", T.DoubleType()),
            T.StructField("elevation", T.DoubleType()),
            T.StructField("timezone", T.StringType()),
        ]
    )
