"""Counts, means, totals, pivots, ranks, top rows and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.functions.scalars import half_even, season
from isobar.operators import quality, rollup
from isobar.plans.foundation import _SEASON_SQL
from isobar.plans.registry import query
from isobar.plans.tables import observations, placed, rounded, stamp_text, table, with_views

YEARS = list(range(1995, 2002))


@query(
    "obs_counts",
    "A1",
    with_views(
        """SELECT CASE WHEN grouping(year) = 1 THEN 'location' WHEN grouping(station_id) = 1 THEN 'year' ELSE 'location_year' END AS level,
                  coalesce(station_id, -1) AS station_id, coalesce(year, -1) AS year, count(*) AS n_obs FROM obs
           GROUP BY GROUPING SETS ((station_id), (year), (station_id, year))"""
    ),
)
def obs_counts(spark, sf_dir):
    counts = rollup.obs_counts(observations(spark, sf_dir), "station_id", "year")
    return counts.fillna(-1, ["station_id", "year"])


@query(
    "group_means",
    "A2",
    with_views(
        """SELECT station_id, coalesce(year, -1) AS year, coalesce(month, -1) AS month, round(avg(temperature), 6) + 0.0 AS temperature,
                  round(avg(rain), 6) + 0.0 AS rain FROM obs GROUP BY GROUPING SETS ((year, station_id), (month, station_id), (station_id))"""
    ),
)
def group_means(spark, sf_dir):
    """Means by (year, station), (month, station) and station."""
    values = ["temperature", "rain"]
    sets = [["station_id", "year"], ["station_id", "month"], ["station_id"]]
    out = rollup.group_means_by_sets(observations(spark, sf_dir), sets, values)
    return rounded(out.fillna(-1, ["year", "month"]), *values).select("station_id", "year", "month", *values)


@query(
    "season_means",
    "A2 F3 F5",
    with_views(
        """SELECT season, round_even(avg(temperature), 2) + 0.0 AS temperature, round_even(avg(wind), 2) + 0.0 AS wind,
                  round_even(avg(pressure), 2) + 0.0 AS pressure FROM s GROUP BY season""",
        f"s AS (SELECT *, {_SEASON_SQL} AS season FROM obs)",
    ),
)
def season_means(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("season", season(F.col("month")))
    out = rollup.group_means(obs, ["season"], ["temperature", "wind", "pressure"], digits=2)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("temperature", "wind", "pressure")})


_AGG_KEYS = ["station_id", "name", "latitude", "longitude", "elevation_m"]
_AGG_SQL = """SELECT station_id, name, latitude, longitude, elevation_m, round(avg(temperature), 6) + 0.0 AS mean_temp,
       round(avg(rain), 6) + 0.0 AS mean_rain, round(sum(rain) / {years}, 6) + 0.0 AS total_rain_per_year,
       round(avg(wind), 6) + 0.0 AS mean_wind, round(avg(humidity), 4) + 0.0 AS mean_humidity
FROM obs JOIN stations USING (station_id) GROUP BY ALL"""
_MEANS = {"mean_temp": "temperature", "mean_rain": "rain", "mean_wind": "wind", "mean_humidity": "humidity"}


def station_aggregate(spark, sf_dir, years="group"):
    return rollup.location_aggregate(
        placed(spark, sf_dir), _AGG_KEYS, _MEANS, {"total_rain_per_year": "rain"}, years=years
    )


def _shown(df):
    return rounded(rounded(df, "mean_temp", "mean_rain", "total_rain_per_year", "mean_wind"), "mean_humidity", digits=4)


@query("location_aggregate", "A3 A4 A14", with_views(_AGG_SQL.format(years="count(DISTINCT year)")))
def location_aggregate(spark, sf_dir):
    """Station means and annual totals over each station's own years."""
    return _shown(station_aggregate(spark, sf_dir))


@query(
    "location_aggregate_global_years", "A3 A4", with_views(_AGG_SQL.format(years="(SELECT count(DISTINCT year) FROM obs)"))
)
def location_aggregate_global_years(spark, sf_dir):
    """The same with the whole table's year count as denominator."""
    return _shown(station_aggregate(spark, sf_dir, "global"))


_NAN_SQL = """
SELECT station_id, round(avg(humidity), 4) + 0.0 AS mean_humidity, round(sum(coalesce(humidity, 0)) / count(DISTINCT year), 4) + 0.0 AS humidity_per_year
FROM obs GROUP BY station_id"""


@query("location_aggregate_nan", "A3 A4", with_views(_NAN_SQL))
def location_aggregate_nan(spark, sf_dir):
    """Means and totals of a measure whose gaps are NaN instead of null."""
    holed = observations(spark, sf_dir).withColumn("humidity", F.coalesce("humidity", F.lit(float("nan"))))
    agg = rollup.location_aggregate(holed, ["station_id"], {"mean_humidity": "humidity"}, {"humidity_per_year": "humidity"})
    return rounded(agg, "mean_humidity", "humidity_per_year", digits=4)


@query(
    "height_summary",
    "A5 A4 O1",
    with_views(
        """SELECT station_id, name, elevation_m, round(avg(temperature), 6) + 0.0 AS mean_temp,
                  round(avg(pressure), 4) + 0.0 AS mean_pressure, round(sum(rain) / count(DISTINCT year), 6) + 0.0 AS mean_rain_per_year
           FROM obs JOIN stations USING (station_id) GROUP BY ALL"""
    ),
)
def height_summary(spark, sf_dir):
    """Station means with pressure, ordered by elevation."""
    agg = rollup.location_aggregate(
        placed(spark, sf_dir),
        ["station_id", "name", "elevation_m"],
        {"mean_temp": "temperature", "mean_pressure": "pressure"},
        {"mean_rain_per_year": "rain"},
    )
    out = rounded(rounded(agg, "mean_temp", "mean_rain_per_year"), "mean_pressure", digits=4)
    return rollup.sorted_by(out, "elevation_m", "station_id")


@query(
    "height_ordered_means",
    "A19 O1",
    with_views(
        """SELECT station_id, name, elevation_m, round(avg(temperature), 6) + 0.0 AS mean_temp, count(*) AS n_obs
           FROM obs LEFT JOIN stations USING (station_id) GROUP BY ALL"""
    ),
)
def height_ordered_means(spark, sf_dir):
    """Join, then mean and count by station in elevation order."""
    out = rollup.means_with_counts(placed(spark, sf_dir), ["station_id", "name", "elevation_m"], {"mean_temp": "temperature"})
    return rollup.sorted_by(rounded(out, "mean_temp"), "elevation_m", "station_id")


@query(
    "two_stage_mean",
    "A6",
    with_views(
        """SELECT month, station_id, round(avg(t), 6) + 0.0 AS rain FROM (
             SELECT month, station_id, year, sum(rain) AS t FROM obs GROUP BY ALL) GROUP BY month, station_id"""
    ),
)
def two_stage_mean(spark, sf_dir):
    """Monthly totals per year, then their mean over years."""
    return rounded(rollup.mean_of_totals(observations(spark, sf_dir), ["month", "station_id"], "year", "rain"), "rain")


@query(
    "daily_mean",
    "A7 F2",
    """SELECT event_type, strftime(ts, '%Y-%m-%d') AS date, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY ALL""",
)
def daily_mean(spark, sf_dir):
    """Resampling to daily means."""
    out = rollup.daily_means(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    return rounded(out, "value").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "pivot_month",
    "A16 D4",
    with_views(
        "SELECT station_id, "
        + ", ".join(f'round(avg(temperature) FILTER (month = {m}), 6) + 0.0 AS "{m}"' for m in range(1, 13))
        + " FROM obs GROUP BY station_id"
    ),
)
def pivot_month(spark, sf_dir):
    """Station x month heat table of means."""
    out = rollup.pivot_mean(observations(spark, sf_dir), "station_id", "month", list(range(1, 13)), "temperature")
    return rounded(out, *[str(m) for m in range(1, 13)])


_RANK_SQL = """m AS (SELECT year, station_id, avg(temperature) AS t FROM obs GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY t DESC) + (count(*) OVER (PARTITION BY year, t) - 1) / 2.0 AS rank FROM m)"""


@query(
    "rank_within_year",
    "W1 A2",
    with_views("SELECT year, station_id, round(t, 6) + 0.0 AS temperature, CAST(rank AS DOUBLE) AS rank FROM r", _RANK_SQL),
)
def rank_within_year(spark, sf_dir):
    """Average-rank ranking of stations inside each year, warmest first."""
    means = rollup.group_means(observations(spark, sf_dir), ["year", "station_id"], ["temperature"])
    return rounded(rollup.rank_within(means, "year", "temperature"), "temperature")


@query(
    "rank_by_year",
    "A17 W1 G5",
    with_views(
        "SELECT station_id, " + ", ".join(f'CAST(max(rank) FILTER (year = {y}) AS DOUBLE) AS "{y}"' for y in YEARS) + " FROM r GROUP BY station_id",
        _RANK_SQL,
    ),
)
def rank_by_year(spark, sf_dir):
    """Rank stability: one row per station, one column per year."""
    return rollup.rank_by_period(observations(spark, sf_dir), "station_id", "year", "temperature", YEARS)


@query(
    "time_delta",
    "W2 A20 O4",
    """SELECT delta_seconds, count(*) AS n FROM (
         SELECT round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY l_suppkey ORDER BY ts)) / 1000000.0, 6) + 0.0 AS delta_seconds
         FROM (SELECT l_suppkey, l_shipdate + to_hours(l_linenumber) AS ts FROM lineitem)) WHERE delta_seconds IS NOT NULL
       GROUP BY 1 ORDER BY n DESC, delta_seconds LIMIT 5""",
)
def time_delta(spark, sf_dir):
    """The five most frequent time steps inside a station."""
    return quality.common_deltas(observations(spark, sf_dir), "station_id", "ts")


@query(
    "time_delta_rows",
    "W2",
    """SELECT event_type, count(*) AS n, round(sum(d), 3) + 0.0 AS total, round(max(d), 6) + 0.0 AS longest FROM (
         SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1000000.0 AS d FROM events)
       WHERE d IS NOT NULL GROUP BY event_type""",
)
def time_delta_rows(spark, sf_dir):
    """Lag differences per station, summed up."""
    gaps = quality.time_deltas(table(spark, sf_dir, "events"), "event_type", "ts")
    later = F.sum("copies") - F.count(F.when(F.col("delta_seconds").isNull(), 1))
    out = gaps.groupBy("event_type").agg(
        later.alias("n"), F.sum("delta_seconds").alias("total"), F.max("delta_seconds").alias("longest")
    )
    return rounded(rounded(out, "total", digits=3), "longest")


def _top_sql(value: str, extra: str) -> str:
    return with_views(
        f"""SELECT station_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, order_id, line_no, {value}, {extra} FROM obs
            WHERE {value} IS NOT NULL ORDER BY {value} DESC, station_id, obs.ts, order_id, line_no LIMIT 10"""
    )


def _top(spark, sf_dir, value: str, extra: str):
    cols = ["station_id", "ts", "order_id", "line_no", value, extra]
    top = rollup.top_rows(observations(spark, sf_dir), value, cols, ["station_id", "ts", "order_id", "line_no"])
    return top.withColumn("ts", stamp_text("ts"))


@query("top_temperature", "O2 P1", _top_sql("temperature", "humidity"))
def top_temperature(spark, sf_dir):
    return _top(spark, sf_dir, "temperature", "humidity")


@query("top_pressure", "O2", _top_sql("pressure", "rain"))
def top_pressure(spark, sf_dir):
    return _top(spark, sf_dir, "pressure", "rain")


@query("top_wind", "O2", _top_sql("wind", "pressure"))
def top_wind(spark, sf_dir):
    return _top(spark, sf_dir, "wind", "pressure")


@query(
    "key_order",
    "O3 O1 F5",
    """SELECT seg AS c_mktsegment, round_even(avg(c_acctbal), 2) + 0.0 AS mean_balance
       FROM (VALUES ('MACHINERY'), ('AUTOMOBILE'), ('NO SUCH SEGMENT'), ('HOUSEHOLD'), ('BUILDING'), ('FURNITURE')) AS k(seg)
       LEFT JOIN customer ON c_mktsegment = seg GROUP BY seg""",
)
def key_order(spark, sf_dir):
    """Rows in a listed key order; a listed key without data gives a null row."""
    means = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        (half_even(F.avg("c_acctbal"), 2) + F.lit(0.0)).alias("mean_balance")
    )
    listed = ["MACHINERY", "AUTOMOBILE", "NO SUCH SEGMENT", "HOUSEHOLD", "BUILDING", "FURNITURE"]
    return rollup.in_key_order(means, "c_mktsegment", listed)


@query(
    "best_station",
    "O5",
    with_views(
        """SELECT arg_min(station_id, m) AS station_id, round(min(m), 6) + 0.0 AS temperature
           FROM (SELECT station_id, avg(temperature) AS m FROM obs GROUP BY 1)"""
    ),
)
def best_station(spark, sf_dir):
    """The label of the row with the smallest score."""
    means = rollup.group_means(observations(spark, sf_dir), ["station_id"], ["temperature"])
    return rounded(rollup.best_by(means, "station_id", "temperature"), "temperature")


@query(
    "seeded_sample",
    "O6",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
       ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_extendedprice),
                l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 2000""",
)
def seeded_sample(spark, sf_dir):
    """2000 rows in seeded hash order: the sampling operator."""
    li = table(spark, sf_dir, "lineitem")
    sample = rollup.seeded_sample(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 2000)
    return sample.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "union_all",
    "U1 A1",
    """SELECT kind, count(*) AS n_obs, round(sum(amount), 2) + 0.0 AS total FROM (
         SELECT 'customer' AS kind, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY kind""",
)
def union_all(spark, sf_dir):
    """Same-schema tables stacked by name."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("amount"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("amount"), F.lit("supplier").alias("kind"))
    out = c.unionByName(s).groupBy("kind").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("amount").alias("total"))
    return rounded(out, "total", digits=2)


@query("distinct_values", "U4 A12", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
