"""Distribution and map tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.functions.scalars import fixed_text
from isobar.operators import distribution as d
from isobar.operators import geo, regression
from isobar.plans.registry import query
from isobar.plans.rollups import station_aggregate
from isobar.plans.tables import observations, placed, rd, rounded, stations, table, with_views
from isobar.session import settle

_VARS = ["temperature", "rain", "wind", "pressure"]
_TALL = "t AS (UNPIVOT (SELECT temperature, rain, wind, pressure FROM obs) ON temperature, rain, wind, pressure INTO NAME variable VALUE value)"
_EDGES = "e AS (SELECT variable, count(*) AS total, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM t GROUP BY variable)"


def _hist_sql(bins: int) -> str:
    return f"""h AS (SELECT variable, lo, hi, least(CAST(floor((value - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) AS bin, count(*) AS n
               FROM t JOIN e USING (variable) GROUP BY ALL)"""


@query(
    "histogram50",
    "D1",
    with_views(
        """SELECT variable, bin, round(lo + (hi - lo) / 50.0 * bin, 6) + 0.0 AS bin_low,
                  round(lo + (hi - lo) / 50.0 * (bin + 1), 6) + 0.0 AS bin_high, n FROM h""",
        f"{_TALL}, {_EDGES}, {_hist_sql(50)}",
    ),
)
def histogram50(spark, sf_dir):
    """Fifty equal-width bins per measure."""
    return rounded(d.histogram(observations(spark, sf_dir), _VARS), "bin_low", "bin_high")


@query(
    "density",
    "D2",
    with_views(
        """SELECT variable, round(x, 6) + 0.0 AS x, round(sum(n * exp(-0.5 * pow((x - centre) / bw, 2)) / (total * bw * sqrt(2 * pi()))), 8) + 0.0 AS density
           FROM (SELECT variable, n, total, sd * pow(total, -0.2) AS bw, h.lo + (h.hi - h.lo) / 1024.0 * (bin + 0.5) AS centre,
                        i, h.lo + (h.hi - h.lo) * i / 199.0 AS x FROM h JOIN e USING (variable), range(0, 200) r(i))
           GROUP BY variable, i, x""",
        f"{_TALL}, {_EDGES}, {_hist_sql(1024)}",
    ),
)
def density(spark, sf_dir):
    """Gaussian kernel density on 200 points."""
    return rounded(rounded(d.density(observations(spark, sf_dir), _VARS), "x"), "density", digits=8)


_BOX_SQL = """SELECT {keys}, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, count(*) AS n,
       min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_low,
       max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
       count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM {src} JOIN b USING ({keys}) GROUP BY {keys}, q1, median, q3"""
_BOX_TALL = """t AS (UNPIVOT (SELECT station_id, temperature, pressure FROM obs) ON temperature, pressure INTO NAME variable VALUE value),
b AS (SELECT station_id, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM t GROUP BY ALL)"""


@query("box_by_station", "D3", with_views(_BOX_SQL.format(keys="station_id, variable", src="t"), _BOX_TALL))
def box_by_station(spark, sf_dir):
    """Box-plot statistics per station and measure."""
    out = d.box_stats(observations(spark, sf_dir), ["temperature", "pressure"], ["station_id"])
    return rounded(out, "q1", "median", "q3")


@query(
    "box_z_scored",
    "D3 F6",
    with_views(
        "SELECT * REPLACE (round(whisker_low, 6) + 0.0 AS whisker_low, round(whisker_high, 6) + 0.0 AS whisker_high) FROM ("
        + _BOX_SQL.format(keys="variable", src="t")
        + ")",
        """t AS (SELECT 'temperature' AS variable, (temperature - (SELECT avg(temperature) FROM obs)) / (SELECT stddev_samp(temperature) FROM obs) AS value FROM obs
            UNION ALL SELECT 'wind', (wind - (SELECT avg(wind) FROM obs)) / (SELECT stddev_samp(wind) FROM obs) FROM obs),
           b AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM t GROUP BY ALL)""",
    ),
)
def box_z_scored(spark, sf_dir):
    """Box-plot statistics of standardised measures."""
    measures = ["temperature", "wind"]
    out = d.box_stats(d.z_scores(observations(spark, sf_dir), measures), measures)
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "box_of_events",
    "D3",
    """WITH t AS (SELECT event_type, 'value' AS variable, value FROM events),
            b AS (SELECT event_type, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM t GROUP BY ALL) """
    + _BOX_SQL.format(keys="event_type, variable", src="t"),
)
def box_of_events(spark, sf_dir):
    """Box-plot statistics of a skewed measure: many points beyond the fences."""
    return rounded(d.box_stats(table(spark, sf_dir, "events"), ["value"], ["event_type"]), "q1", "median", "q3")


@query(
    "z_scores",
    "F6",
    with_views(
        """SELECT order_id, line_no, station_id, day, round((temperature - avg(temperature) OVER ()) / stddev_samp(temperature) OVER (), 6) + 0.0 AS temperature,
                  round((pressure - avg(pressure) OVER ()) / stddev_samp(pressure) OVER (), 6) + 0.0 AS pressure FROM obs"""
    ),
)
def z_scores(spark, sf_dir):
    """Standardised measures, row by row."""
    z = d.z_scores(observations(spark, sf_dir), ["temperature", "pressure"])
    return rounded(z, "temperature", "pressure").select("order_id", "line_no", "station_id", "day", "temperature", "pressure")


_STATION_MEANS = """a AS (SELECT station_id, elevation_m, latitude, longitude, avg(temperature) AS mean_temp, avg(wind) AS mean_wind,
  avg(rain) AS mean_rain, avg(humidity) AS mean_humidity, sum(rain) / count(DISTINCT year) AS total_rain_per_year, min(name) AS name
  FROM obs JOIN stations USING (station_id) GROUP BY station_id, elevation_m, latitude, longitude)"""


@query(
    "fit_line",
    "D5 C5",
    with_views(
        """SELECT round(x, 6) + 0.0 AS x, round(b + m * x, 6) + 0.0 AS y FROM (
             SELECT lo + (hi - lo) * i / 49.0 AS x, b, m FROM (SELECT min(elevation_m) AS lo, max(elevation_m) AS hi,
               regr_slope(mean_temp, elevation_m) AS m, regr_intercept(mean_temp, elevation_m) AS b FROM a), range(0, 50) r(i))""",
        _STATION_MEANS,
    ),
)
def fit_line(spark, sf_dir):
    """The least-squares line at 50 even points."""
    return rounded(d.fit_line(station_aggregate(spark, sf_dir), "elevation_m", "mean_temp"), "x", "y")


@query(
    "fitted_rows",
    "D6 F7",
    with_views(
        """SELECT order_id, line_no, temperature AS actual, round(b + m * elevation_m, 6) + 0.0 AS fitted,
                  round(temperature - (b + m * elevation_m), 6) + 0.0 AS residual, round(abs(temperature - (b + m * elevation_m)), 6) + 0.0 AS abs_error
           FROM obs JOIN stations USING (station_id), (SELECT regr_slope(temperature, elevation_m) AS m, regr_intercept(temperature, elevation_m) AS b
                FROM obs JOIN stations USING (station_id))"""
    ),
)
def fitted_rows(spark, sf_dir):
    """Actual, fitted and residual of every row under the one-regressor model."""
    df = placed(spark, sf_dir)
    fit = regression.fit_clustered(df, "temperature", ["elevation_m"], "station_id")
    out = d.residuals(fit.predict(df), "temperature", "fitted")
    out = out.select("order_id", "line_no", F.col("temperature").alias("actual"), "fitted", "residual", "abs_error")
    return rounded(out, "fitted", "residual", "abs_error")


@query(
    "binned_scatter",
    "D6",
    with_views(
        "SELECT CAST(floor(temperature / 5.0) AS BIGINT) AS x_cell, CAST(floor(pressure / 10000.0) AS BIGINT) AS y_cell, count(*) AS n FROM obs GROUP BY ALL"
    ),
)
def binned_scatter(spark, sf_dir):
    """A scatter plot as counts on a grid."""
    return d.binned_scatter(observations(spark, sf_dir), "temperature", "pressure", 5.0, 10000.0)


@query(
    "span_gate",
    "A21 A12",
    with_views(
        """SELECT count(*) AS n_locations, min(elevation_m) AS lowest, max(elevation_m) AS highest, max(elevation_m) - min(elevation_m) AS span,
                  count(DISTINCT elevation_m) AS distinct_heights,
                  CASE WHEN max(elevation_m) - min(elevation_m) < 100 THEN 'insufficient' ELSE 'sufficient' END AS status FROM stations"""
    ),
)
def span_gate(spark, sf_dir):
    """Is there enough spread in elevation to look for an effect?"""
    return geo.span_gate(stations(spark, sf_dir), "elevation_m")


@query(
    "tertile_means",
    "A22",
    with_views(
        """SELECT g AS elevation_group, count(station_id) AS n, round_even(avg(mean_temp), 2) + 0.0 AS mean_temp, round_even(avg(mean_wind), 2) + 0.0 AS mean_wind
           FROM (VALUES ('Low'), ('Medium'), ('High')) l(g) LEFT JOIN (
             SELECT a.*, CASE WHEN elevation_m <= q1 THEN 'Low' WHEN elevation_m <= q2 THEN 'Medium' ELSE 'High' END AS lab
             FROM a, (SELECT quantile_cont(elevation_m, 1.0 / 3) AS q1, quantile_cont(elevation_m, 2.0 / 3) AS q2 FROM a)) ON lab = g GROUP BY g""",
        _STATION_MEANS,
    ),
)
def tertile_means(spark, sf_dir):
    """Low / Medium / High elevation groups by interpolated thirds."""
    out = geo.tertile_means(settle(station_aggregate(spark, sf_dir)), "elevation_m", ["mean_temp", "mean_wind"])
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("mean_temp", "mean_wind")})


_MARK = """m AS (SELECT *, min(mean_temp) OVER () AS lo, max(mean_temp) OVER () AS hi FROM (
  SELECT station_id, name, elevation_m, latitude, longitude, round(mean_temp, 6) + 0.0 AS mean_temp, round(mean_wind, 6) + 0.0 AS mean_wind FROM a))"""
_POPUP_SQL = "printf('%s: %.0f m, %.3f C', name, round(elevation_m, 0), round(mean_temp, 3) + 0.0)"
_FRAC = "((mean_temp - lo) / (hi - lo))"


def _markers(spark, sf_dir):
    agg = settle(rounded(station_aggregate(spark, sf_dir), "mean_temp", "mean_wind"))
    popup = fixed_text("%s: %.0f m, %.3f C", F.col("name"), F.round("elevation_m", 0), rd("mean_temp", 3))
    return geo.marker_table(agg, "mean_temp", "name", popup)


@query(
    "marker_table",
    "G2 F8 F9 F10",
    with_views(
        f"""SELECT name AS tooltip, latitude AS lat, longitude AS lon, round(10 + (mean_temp - lo) * 4, 6) + 0.0 AS radius,
                   printf('#%02x30%02x', CAST(trunc(255 * {_FRAC}) AS INTEGER), CAST(trunc(255 * (1 - {_FRAC})) AS INTEGER)) AS fill_color,
                   {_POPUP_SQL} AS popup FROM m""",
        f"{_STATION_MEANS}, {_MARK}",
    ),
)
def marker_table(spark, sf_dir):
    """Position, radius, colour, popup and tooltip per station."""
    return rounded(_markers(spark, sf_dir), "radius")


@query(
    "geojson",
    "G3",
    with_views(
        """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || printf('%.1f', longitude) || ',' || printf('%.1f', latitude) ||
                  ']},"properties":{"tooltip":"' || name || '"}}' AS feature FROM a""",
        _STATION_MEANS,
    ),
)
def geojson(spark, sf_dir):
    """One GeoJSON feature per station."""
    return geo.geojson_features(_markers(spark, sf_dir), ["tooltip"])


@query(
    "map_centre",
    "G1",
    with_views("SELECT round(avg(latitude), 6) + 0.0 AS centre_lat, round(avg(longitude), 6) + 0.0 AS centre_lon FROM a", _STATION_MEANS),
)
def map_centre(spark, sf_dir):
    return rounded(geo.map_centre(station_aggregate(spark, sf_dir)), "centre_lat", "centre_lon")


def _gradient_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{ax}' AS axis, '{m}' AS measure, round(regr_slope({m}, {ax}), 6) + 0.0 AS slope, round(pow(corr({m}, {ax}), 2), 6) + 0.0 AS r_squared FROM a"
        for ax in ("latitude", "longitude")
        for m in ("mean_temp", "total_rain_per_year", "mean_wind")
    )
    return with_views(f"SELECT * FROM ({each})", _STATION_MEANS)


@query("gradients", "G4 C5", _gradient_sql())
def gradients(spark, sf_dir):
    """Slope and fit of each measure along latitude and longitude."""
    out = geo.gradients(
        station_aggregate(spark, sf_dir), ["latitude", "longitude"], ["mean_temp", "total_rain_per_year", "mean_wind"]
    )
    return rounded(out, "slope", "r_squared")
