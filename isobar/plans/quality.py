"""Missingness, bounds, duplicates, describe, coverage and quota queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import quality as q
from isobar.plans.registry import query
from isobar.plans.tables import observations, rounded, stations, stamp_text, table, with_views

_OBS_COLUMNS = (
    "station_id order_id line_no ts year month day hour temperature rain wind pressure humidity".split()
)


def _missing_union() -> str:
    each = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
            round_even((count(*) - count({c})) * 100.0 / count(*), 3) + 0.0 AS missing_pct FROM obs"""
        for c in _OBS_COLUMNS
    )
    return with_views(f"SELECT * FROM ({each})")


@query("missing_overall", "A8 P7 F17", _missing_union())
def missing_overall(spark, sf_dir):
    """Missing count and share of every column in one scan."""
    return q.missing_overall(observations(spark, sf_dir))


@query(
    "missing_any",
    "P9 A8",
    with_views(
        """SELECT 'humidity' AS "column", count(*) - count(humidity) AS missing_count,
                  round_even((count(*) - count(humidity)) * 100.0 / count(*), 3) + 0.0 AS missing_pct FROM obs"""
    ),
)
def missing_any(spark, sf_dir):
    """Only the columns with gaps."""
    return q.with_any_missing(q.missing_overall(observations(spark, sf_dir)))


def _missing_by(key: str) -> str:
    vals = ", ".join(
        f"round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) + 0.0 AS {c}" for c in ("temperature", "humidity")
    )
    return with_views(f"SELECT {key}, {vals} FROM obs GROUP BY {key}")


@query("missing_by_station", "A9", _missing_by("station_id"))
def missing_by_station(spark, sf_dir):
    return q.missing_by_group(observations(spark, sf_dir), "station_id", ["temperature", "humidity"])


@query("missing_by_year", "A9", _missing_by("year"))
def missing_by_year(spark, sf_dir):
    return q.missing_by_group(observations(spark, sf_dir), "year", ["temperature", "humidity"])


@query("missing_by_month", "A9", _missing_by("month"))
def missing_by_month(spark, sf_dir):
    return q.missing_by_group(observations(spark, sf_dir), "month", ["temperature", "humidity"])


@query(
    "missing_count_by_year",
    "A10",
    with_views("SELECT year, count(*) - count(humidity) AS missing_count FROM obs GROUP BY year"),
)
def missing_count_by_year(spark, sf_dir):
    """Where the gaps of one measure fall."""
    return q.missing_count_by_group(observations(spark, sf_dir), "year", "humidity")


_BOUNDS = {"temperature": (2, 49), "rain": (0, 0.09), "wind": (0, 0.08), "pressure": (1000, 90000), "humidity": (0, 60000), "snow": (0, 1)}


def _bounds_sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '[{lo:g}, {hi:g}]' AS valid_range, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS n_invalid,
            round_even(count(*) FILTER ({c} < {lo} OR {c} > {hi}) * 100.0 / count(*), 4) + 0.0 AS pct_invalid FROM obs"""
        for c, (lo, hi) in _BOUNDS.items()
        if c != "snow"
    )
    return with_views(f"SELECT * FROM ({each})")


@query("bounds_check", "P5 F14 F5 F17", _bounds_sql())
def bounds_check(spark, sf_dir):
    """Values outside closed intervals, all columns in one pass; an absent column is skipped."""
    return q.bounds_check(observations(spark, sf_dir), _BOUNDS)


@query("outside_years", "P6", with_views("SELECT count(*) FILTER (year < 1996 OR year > 2000) AS n_outside FROM obs"))
def outside_years(spark, sf_dir):
    return q.outside_years(observations(spark, sf_dir), "ts", 1996, 2000)


@query(
    "positive_counts",
    "P8",
    with_views(
        """SELECT 'rain' AS "column", count(*) FILTER (rain > 0) AS n_positive FROM obs UNION ALL
           SELECT 'wind', count(*) FILTER (wind > 0) FROM obs"""
    ),
)
def positive_counts(spark, sf_dir):
    return q.positive_counts(observations(spark, sf_dir), ["rain", "wind"])


@query(
    "duplicate_report",
    "U2 U3",
    """SELECT (SELECT coalesce(CAST(sum(c - 1) AS BIGINT), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS exact_duplicates,
              (SELECT coalesce(CAST(sum(c - 1) AS BIGINT), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS key_duplicates""",
)
def duplicate_report(spark, sf_dir):
    """Fully repeated rows over all columns (nulls equal) and repeated keys."""
    return q.duplicate_report(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_DESCRIBED = ["temperature", "rain", "wind", "pressure", "humidity"]


def _describe_sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS "count", round(avg({c}), 5) + 0.0 AS mean, round(stddev_samp({c}), 5) + 0.0 AS std,
            min({c}) AS min, round(quantile_cont({c}, 0.25), 5) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 5) + 0.0 AS p50,
            round(quantile_cont({c}, 0.75), 5) + 0.0 AS p75, max({c}) AS max, round(skewness({c}), 5) + 0.0 AS skew FROM obs"""
        for c in _DESCRIBED
    )
    return with_views(f"SELECT * FROM ({each})")


@query("describe_skew", "A13 A15", _describe_sql())
def describe_skew(spark, sf_dir):
    """count, mean, sd, min, quartiles, max, corrected skew per measure."""
    out = q.describe(observations(spark, sf_dir), _DESCRIBED)
    return rounded(out, "mean", "std", "p25", "p50", "p75", "skew", digits=5)


@query(
    "table_profile",
    "A11 A12",
    with_views(
        f"""SELECT count(*) AS total_rows, count(DISTINCT station_id) AS total_locations, count(DISTINCT year) AS total_years,
                  CAST({len(_OBS_COLUMNS)} AS INTEGER) AS total_columns FROM obs"""
    ),
)
def table_profile(spark, sf_dir):
    return q.table_profile(observations(spark, sf_dir), "station_id", "year")


_FOUND = "f AS (SELECT station_id, year, count(*) AS n FROM obs GROUP BY ALL)"
_HOURS = "CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 8784 ELSE 8760 END"


@query(
    "coverage",
    "I1",
    with_views(
        f"""SELECT s.station_id, CAST(y AS INTEGER) AS year, CAST({_HOURS} AS INTEGER) AS expected_hours, coalesce(n, 0) AS n_obs,
                   coalesce(n, 0) > 0 AS present, round(coalesce(n, 0) * 100.0 / {_HOURS}, 6) + 0.0 AS completion_pct
            FROM stations s JOIN range(1995, 2003) r(y) ON true LEFT JOIN f ON f.station_id = s.station_id AND f.year = y""",
        _FOUND,
    ),
)
def coverage(spark, sf_dir):
    """Expected against found hours per station and year, with one year still to come."""
    have = observations(spark, sf_dir)
    out = q.coverage(stations(spark, sf_dir).select("station_id"), have, "station_id", "year", 1995, 2002)
    return rounded(out, "completion_pct")


@query(
    "missing_chunks",
    "I1",
    with_views(
        """SELECT s.station_id, CAST(y AS INTEGER) AS year FROM stations s JOIN range(1995, 2003) r(y) ON true
           WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.station_id = s.station_id AND f.year = y)""",
        _FOUND,
    ),
)
def missing_chunks(spark, sf_dir):
    """(station, year) pairs still to be delivered."""
    have = observations(spark, sf_dir)
    return q.missing_chunks(stations(spark, sf_dir).select("station_id"), have, "station_id", "year", 1995, 2002)


@query(
    "hour_gaps",
    "I2",
    """WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour_start FROM events),
            s AS (SELECT event_type, min(hour_start) AS lo, max(hour_start) AS hi FROM h GROUP BY 1),
            g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour_start FROM s)
       SELECT event_type, strftime(hour_start, '%Y-%m-%d %H:%M:%S') AS hour_start FROM (SELECT * FROM g EXCEPT SELECT * FROM h)""",
)
def hour_gaps(spark, sf_dir):
    """Hours without any row inside each key's span."""
    kept = table(spark, sf_dir, "events")
    return q.hour_gaps(kept, "event_type", "ts").withColumn("hour_start", stamp_text("hour_start"))


@query(
    "rolling_usage",
    "I3",
    """WITH p AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, sum(value) AS cost FROM events GROUP BY ALL)
       SELECT event_type, epoch, round(cost, 4) + 0.0 AS cost,
              round(sum(cost) OVER (PARTITION BY event_type ORDER BY epoch RANGE BETWEEN 60 PRECEDING AND CURRENT ROW), 4) + 0.0 AS minute,
              round(sum(cost) OVER (PARTITION BY event_type ORDER BY epoch RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 4) + 0.0 AS hour
       FROM p""",
)
def rolling_usage(spark, sf_dir):
    """Trailing 60 s and 3600 s cost per source."""
    ev = table(spark, sf_dir, "events").select(
        "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"), "value"
    )
    out = q.rolling_usage(ev, "event_type", "epoch", "value", {"minute": 60, "hour": 3600})
    return rounded(out, "cost", "minute", "hour", digits=4)
