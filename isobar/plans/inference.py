"""Correlation, hypothesis tests and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import correlation as c
from isobar.operators import hypothesis as h
from isobar.operators import regression, rollup
from isobar.operators.geo import span_gate
from isobar.operators.ordered import value_ranks
from isobar.plans.registry import query
from isobar.plans.rollups import station_aggregate
from isobar.plans.shapes import _STATION_MEANS
from isobar.plans.tables import observations, placed, rd, rounded, stations, table, with_views
from isobar.session import settle

_COLS = ["temperature", "rain", "wind", "pressure", "humidity", "elevation_m", "latitude", "longitude"]
_PLACED = "p AS (SELECT obs.*, name, region, country, latitude, longitude, elevation_m FROM obs JOIN stations USING (station_id))"


def _nan_null(expr: str, digits: int = 6) -> str:
    return f"round(CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END, {digits}) + 0.0"


def _pairs_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, {_nan_null(f'corr({x}, {y})')} AS r FROM p"
        for i, x in enumerate(_COLS)
        for y in _COLS[i + 1 :]
    )
    return with_views(f"SELECT * FROM ({each})", _PLACED)


@query("pearson_pairs", "C1", _pairs_sql())
def pearson_pairs(spark, sf_dir):
    """Pearson r of every pair of eight columns, pairwise complete, in one pass."""
    return rounded(c.pearson_pairs(placed(spark, sf_dir), _COLS), "r")


def _matrix_sql(ranked: bool) -> str:
    """All columns against all, each pair over the rows where both are set."""

    def one(x: str, y: str) -> str:
        values = [f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0" if ranked else v for v in (x, y)]
        both = f"SELECT {values[0]} AS v0, {values[1]} AS v1 FROM p WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        return f"SELECT '{x}' AS x, '{y}' AS y, round(corr(v0, v1), 6) + 0.0 AS r FROM ({both})"

    pairs = " UNION ALL ".join(one(x, y) for i, x in enumerate(_COLS) for y in _COLS[i + 1 :])
    diagonal = " UNION ALL ".join(f"SELECT '{v}', '{v}', 1.0::DOUBLE" for v in _COLS)
    square = f"SELECT x, y, r FROM pairs UNION ALL SELECT y, x, r FROM pairs UNION ALL {diagonal}"
    cells = ", ".join(f"max(r) FILTER (y = '{v}') AS {v}" for v in _COLS)
    return with_views(f"SELECT x AS variable, {cells} FROM square GROUP BY x", f"{_PLACED}, pairs AS ({pairs}), square AS ({square})")


@query("pearson_matrix", "C1 A17", _matrix_sql(ranked=False))
def pearson_matrix(spark, sf_dir):
    """The same in square form."""
    pairs = c.pearson_pairs(placed(spark, sf_dir), _COLS)
    return rounded(c.matrix_form(pairs, _COLS), *_COLS)


@query("spearman_matrix", "C2 W3", _matrix_sql(ranked=True))
def spearman_matrix(spark, sf_dir):
    """Spearman matrix over average ranks, a column with gaps among them."""
    pairs = c.spearman_all_pairs(placed(spark, sf_dir), _COLS)
    return rounded(c.matrix_form(pairs, _COLS), *_COLS)


@query(
    "average_ranks",
    "W3",
    with_views(
        """SELECT temperature, count(*) AS c, CAST(min(r) + (count(*) - 1) / 2.0 AS DOUBLE) AS avg_rank
           FROM (SELECT temperature, rank() OVER (ORDER BY temperature) AS r FROM obs) GROUP BY temperature"""
    ),
)
def average_ranks(spark, sf_dir):
    """Average rank of every distinct value of a column."""
    return value_ranks(observations(spark, sf_dir), "temperature").select("temperature", F.col("_c").alias("c"), "avg_rank")


FOCUS = [
    ("elevation_m", "temperature"), ("elevation_m", "rain"), ("elevation_m", "humidity"), ("latitude", "temperature"),
    ("longitude", "pressure"), ("humidity", "temperature"), ("pressure", "elevation_m"),
]


def _focus_sql() -> str:
    def one(x, y):
        ranked = ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r{i}" for i, v in enumerate((x, y)))
        return f"""SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) + 0.0 AS pearson_r, round(corr(r0, r1), 6) + 0.0 AS spearman_r,
               (SELECT count(DISTINCT {x}) FROM p) AS n_distinct_x_values, count(*) AS n_rows
               FROM (SELECT {x}, {y}, {ranked} FROM p WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""

    return with_views(f"SELECT * FROM ({' UNION ALL '.join(one(x, y) for x, y in FOCUS)})", _PLACED)


@query("focused_pairs", "C3 A12 W3", _focus_sql())
def focused_pairs(spark, sf_dir):
    """Row-level r and rho of chosen pairs, distinct x and complete rows."""
    out = c.focused_pairs(placed(spark, sf_dir), FOCUS).drop("pearson_p", "spearman_p")
    return rounded(out, "pearson_r", "spearman_r")


@query("focused_pair_p_values", "C3")
def focused_pair_p_values(spark, sf_dir):
    """The same with p-values (no t distribution in SQL)."""
    return c.focused_pairs(placed(spark, sf_dir), FOCUS)


_LEVEL = [("elevation_m", "mean_temp"), ("elevation_m", "mean_rain"), ("latitude", "mean_temp"), ("longitude", "mean_wind"), ("no_such_column", "mean_temp")]


@query(
    "location_pairs",
    "C4 A14",
    with_views(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) + 0.0 AS pearson_r, count(*) AS n FROM a HAVING count(DISTINCT {x}) >= 3"
            for x, y in _LEVEL[:-1]
        )
        + ")",
        _STATION_MEANS,
    ),
)
def location_pairs(spark, sf_dir):
    """Pearson on station means; pairs with an absent column are skipped."""
    return rounded(c.location_pairs(station_aggregate(spark, sf_dir), _LEVEL).drop("pearson_p"), "pearson_r")


@query(
    "height_relationships",
    "C6 A21",
    with_views(
        "SELECT *, 'sufficient' AS elevation_variation_status FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{v}' AS variable, round(corr(elevation_m, {v}), 6) + 0.0 AS pearson_r, round(corr(r0, r1), 6) + 0.0 AS spearman_r, count(*) AS n_locations
                FROM (SELECT elevation_m, {v}, rank() OVER (ORDER BY elevation_m) + (count(*) OVER (PARTITION BY elevation_m) - 1) / 2.0 AS r0,
                             rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r1
                      FROM (SELECT elevation_m, round(mean_temp, 6) + 0.0 AS mean_temp, round(mean_wind, 6) + 0.0 AS mean_wind FROM a))"""
            for v in ("mean_temp", "mean_wind")
        )
        + ")",
        _STATION_MEANS,
    ),
)
def height_relationships(spark, sf_dir):
    """Pearson and Spearman of station means with elevation, and the span verdict."""
    # Rounded first: the last bit of a mean must not make or break a tie in rank.
    agg = settle(rounded(station_aggregate(spark, sf_dir), "mean_temp", "mean_wind"))
    status = span_gate(agg, "elevation_m").first().status
    out = c.height_relationships(agg, "elevation_m", ["mean_temp", "mean_wind"], status)
    return rounded(out.drop("pearson_p", "spearman_p"), "pearson_r", "spearman_r")


@query(
    "corr_by_month",
    "C7 J5",
    with_views(
        """SELECT month, round(CASE WHEN count(DISTINCT elevation_m) > 2 THEN corr(t, elevation_m) END, 6) + 0.0 AS pearson_r
           FROM (SELECT station_id, month, avg(temperature) AS t FROM obs GROUP BY ALL) JOIN stations USING (station_id) GROUP BY month"""
    ),
)
def corr_by_month(spark, sf_dir):
    """Correlation of elevation and temperature over stations, month by month."""
    monthly = rollup.group_means(observations(spark, sf_dir), ["station_id", "month"], ["temperature"])
    both = rollup.attach_constants(monthly, stations(spark, sf_dir), "station_id", ["elevation_m"])
    return rounded(c.corr_by_group(both, "month", "elevation_m", "temperature"), "pearson_r")


@query(
    "line_fit",
    "C5",
    with_views(
        """SELECT count(*) AS n, round(regr_slope(temperature, elevation_m), 9) + 0.0 AS slope, round(regr_intercept(temperature, elevation_m), 6) + 0.0 AS intercept,
                  round(corr(temperature, elevation_m), 6) + 0.0 AS r,
                  round(sqrt((1 - pow(corr(temperature, elevation_m), 2)) * regr_syy(temperature, elevation_m) / regr_sxx(temperature, elevation_m) / (count(*) - 2)), 9) + 0.0 AS std_err
           FROM p""",
        _PLACED,
    ),
)
def line_fit(spark, sf_dir):
    """Simple least squares with standard error."""
    out = c.line_fit(placed(spark, sf_dir), "elevation_m", "temperature").drop("p_value")
    return rounded(rounded(out, "intercept", "r"), "slope", "std_err", digits=9)


_DAILY = "dm AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL)"
_ANOVA = """SELECT round((sb / (k - 1)) / (sw / (n - k)), 6) + 0.0 AS statistic, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2
  FROM (SELECT sum(cnt * pow(m - (SELECT avg(v) FROM s), 2)) AS sb, sum(cnt * vp) AS sw, count(*) AS k, sum(cnt) AS n
        FROM (SELECT g, count(*) AS cnt, avg(v) AS m, var_pop(v) AS vp FROM s GROUP BY g))"""


def _daily(spark, sf_dir):
    return rollup.daily_means(table(spark, sf_dir, "events"), "event_type", "ts", "value")


@query("anova", "C10 A7", f"WITH {_DAILY}, s AS (SELECT event_type AS g, value AS v FROM dm) {_ANOVA}")
def anova(spark, sf_dir):
    """One-way analysis of variance of daily means."""
    return rounded(h.anova(_daily(spark, sf_dir), "event_type", "value").drop("p_value"), "statistic")


@query(
    "levene",
    "C9",
    f"WITH {_DAILY}, s AS (SELECT event_type AS g, abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY event_type)) AS v FROM dm) {_ANOVA}",
)
def levene(spark, sf_dir):
    """Equality of variances about the median."""
    return rounded(h.levene(_daily(spark, sf_dir), "event_type", "value").drop("p_value"), "statistic")


_KRUSKAL = """SELECT round(12.0 / (n * (n + 1)) * b / (1 - ties), 6) + 0.0 AS statistic, CAST(k - 1 AS DOUBLE) AS df
  FROM (SELECT sum(cnt * pow(m - (n + 1) / 2.0, 2)) AS b, count(*) AS k, max(n) AS n FROM (
          SELECT g, count(*) AS cnt, avg(r) AS m, max(n) AS n FROM (
            SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER () AS n FROM s) GROUP BY g)),
       (SELECT sum(CAST(t AS DOUBLE) * t * t - t) / max(CAST(n AS DOUBLE) * n * n - n) AS ties
        FROM (SELECT v, count(*) AS t, (SELECT count(*) FROM s) AS n FROM s GROUP BY v))"""


@query("kruskal", "C11 C13 W3", with_views(_KRUSKAL, "s AS (SELECT station_id AS g, rain AS v FROM obs)"))
def kruskal(spark, sf_dir):
    """Kruskal-Wallis on a zero-inflated measure with many ties."""
    return rounded(h.kruskal(observations(spark, sf_dir), "station_id", "rain").drop("p_value"), "statistic")


@query(
    "normality_jb",
    "C8",
    """SELECT event_type, count(*) AS n, round(count(*) / 6.0 * (pow(s3 / pow(s2, 1.5), 2) + pow(s4 / (s2 * s2) - 3, 2) / 4), 4) + 0.0 AS statistic FROM (
         SELECT event_type, value, avg(pow(value - m, 2)) OVER w AS s2, avg(pow(value - m, 3)) OVER w AS s3, avg(pow(value - m, 4)) OVER w AS s4
         FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events) WINDOW w AS (PARTITION BY event_type))
       GROUP BY event_type, s2, s3, s4""",
)
def normality_jb(spark, sf_dir):
    """Moment-based normality per group for groups of any size."""
    out = h.jarque_bera(table(spark, sf_dir, "events"), "event_type", "value").drop("p_value")
    return rounded(out, "statistic", digits=4)


@query("shapiro", "C8 O6")
def shapiro(spark, sf_dir):
    """Shapiro-Wilk per group on at most 4999 seeded rows."""
    return h.shapiro_by_group(table(spark, sf_dir, "events"), "event_type", "value", ["event_id"])


@query("hypothesis_battery", "C12 C13 C14 C15 A7")
def hypothesis_battery(spark, sf_dir):
    """Assumption-driven group test, rank test and location correlations in one table."""
    return h.battery(
        placed(spark, sf_dir),
        "station_id",
        "ts",
        compare={"H1_temperature_by_location": "temperature"},
        ranks={"H2_rainfall_by_location": "rain"},
        relations={
            "H3_elevation_temperature": ("elevation_m", "temperature"),
            "H4_elevation_rainfall": ("elevation_m", "rain"),
            "H5_elevation_wind": ("elevation_m", "wind"),
            "H6_latitude_temperature": ("latitude", "temperature"),
        },
    )


@query(
    "location_correlations",
    "C14 C15",
    with_views(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS test, 'Pearson correlation' AS test_used, round(corr({x}, {y}), 6) + 0.0 AS statistic FROM a"
            for n, x, y in (("H3", "elevation_m", "mean_temp"), ("H4", "elevation_m", "mean_rain"), ("H6", "latitude", "mean_temp"))
        )
        + ")",
        _STATION_MEANS,
    ),
)
def location_correlations(spark, sf_dir):
    """The correlation rows of the battery."""
    agg = settle(station_aggregate(spark, sf_dir))
    tests = [("H3", "elevation_m", "mean_temp"), ("H4", "elevation_m", "mean_rain"), ("H6", "latitude", "mean_temp")]
    first, *rest = [h.location_correlation(agg, x, y, n) for n, x, y in tests]
    for row in rest:
        first = first.unionByName(row)
    return rounded(first.select("test", "test_used", "statistic"), "statistic")


@query(
    "ols_one_regressor",
    "C16 C17 C18",
    with_views(
        """SELECT term, round(coef, 8) + 0.0 AS coef, round(se, 8) + 0.0 AS std_err FROM (
             SELECT unnest(['Intercept', 'elevation_m']) AS term, unnest([b0, b1]) AS coef,
                    unnest([sqrt(sc * v0), sqrt(sc * v1)]) AS se
             FROM (SELECT max(b0) AS b0, max(b1) AS b1, count(*) / (count(*) - 1.0) * (max(n) - 1) / (max(n) - 2) AS sc,
                          sum(pow(s1 / max_sxx, 2)) AS v1, sum(pow(s0 / n - mx * s1 / max_sxx, 2)) AS v0
                   FROM (SELECT station_id, max(b0) AS b0, max(b1) AS b1, max(n) AS n, max(sxx) AS max_sxx, max(mx) AS mx,
                                sum(temperature - b0 - b1 * elevation_m) AS s0, sum((elevation_m - mx) * (temperature - b0 - b1 * elevation_m)) AS s1
                         FROM p, f GROUP BY station_id)))""",
        _PLACED
        + """, f AS (SELECT regr_intercept(temperature, elevation_m) AS b0, regr_slope(temperature, elevation_m) AS b1, count(*) AS n,
               regr_sxx(temperature, elevation_m) AS sxx, avg(elevation_m) AS mx FROM p)""",
    ),
)
def ols_one_regressor(spark, sf_dir):
    """Coefficients and cluster-robust errors of the one-regressor model."""
    fit = regression.fit_clustered(placed(spark, sf_dir), "temperature", ["elevation_m"], "station_id")
    return rounded(fit.table(spark).select("term", "coef", "std_err"), "coef", "std_err", digits=8)


@query(
    "ols_absorbed",
    "C16 C17 C18",
    with_views(
        """SELECT round(b, 8) + 0.0 AS coef, round(sqrt(g / (g - 1.0) * (n - 1) / (n - 1 - days) * v), 8) + 0.0 AS std_err,
                  round(1 - rss / tss, 8) + 0.0 AS r_squared, n, days
           FROM (SELECT max(b) AS b, count(*) AS g, max(n) AS n, max(days) AS days, sum(pow(score / sxx, 2)) AS v, sum(rss) AS rss, max(tss) AS tss
                 FROM (SELECT station_id, max(b) AS b, max(n) AS n, max(days) AS days, max(sxx) AS sxx, max(tss) AS tss,
                              sum(dx * (dy - b * dx)) AS score, sum(pow(dy - b * dx, 2)) AS rss
                       FROM d, f GROUP BY station_id))""",
        _PLACED
        + """, d AS (SELECT station_id, temperature, CAST(ts AS DATE) AS day,
               temperature - avg(temperature) OVER (PARTITION BY CAST(ts AS DATE)) AS dy,
               elevation_m - avg(elevation_m) OVER (PARTITION BY CAST(ts AS DATE)) AS dx
               FROM p WHERE temperature IS NOT NULL AND elevation_m IS NOT NULL AND ts IS NOT NULL),
             f AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS sxx, count(*) AS n,
               count(DISTINCT day) AS days, var_pop(temperature) * count(*) AS tss FROM d)""",
    ),
)
def ols_absorbed(spark, sf_dir):
    """Elevation with one effect per calendar day, thousands of them, clustered by station."""
    df = placed(spark, sf_dir).withColumn("day", F.to_date("ts"))
    fit = regression.fit_clustered(df, "temperature", ["elevation_m"], "station_id", "day")
    row = fit.table(spark).select("coef", "std_err")
    row = row.withColumns({"r_squared": F.lit(fit.r_squared), "n": F.lit(fit.n).cast("bigint")})
    days = fit.effects.agg(F.count("*").alias("days"))
    return rounded(row.withColumn("days", F.lit(days.first()[0]).cast("bigint")), "coef", "std_err", "r_squared", digits=8)


@query("ols_cluster", "C16 C17")
def ols_cluster(spark, sf_dir):
    """Elevation, latitude, longitude, month dummies and year, clustered by station."""
    fit = regression.fit_clustered(
        placed(spark, sf_dir), "temperature", ["elevation_m", "latitude", "longitude", "year"], "station_id", "month"
    )
    return fit.table(spark)


@query("regression_comparison", "C18")
def regression_comparison(spark, sf_dir):
    """R-squared, adjusted R-squared and the elevation term of three nested models."""
    place = ("elevation_m", "latitude", "longitude")
    specs = {
        "1: Elevation only": (place[:1], None),
        "2: + Lat/Lon": (place, None),
        "3: + Month + Year": ((*place, "year"), "month"),
    }
    fits = regression.fit_nested(placed(spark, sf_dir), "temperature", specs, "station_id")
    return regression.comparison(spark, fits, "elevation_m")


@query(
    "r_squared_one_regressor",
    "C18",
    with_views(
        """SELECT round(regr_r2(temperature, elevation_m), 8) + 0.0 AS r_squared,
                  round(1 - (1 - regr_r2(temperature, elevation_m)) * (count(*) - 1) / (count(*) - 2), 8) + 0.0 AS adj_r_squared, count(*) AS n FROM p""",
        _PLACED,
    ),
)
def r_squared_one_regressor(spark, sf_dir):
    fit = regression.fit_clustered(placed(spark, sf_dir), "temperature", ["elevation_m"], "station_id")
    row = spark.createDataFrame([(fit.r_squared, fit.adj_r_squared, fit.n)], "r_squared double, adj_r_squared double, n long")
    return row.select(rd("r_squared", 8).alias("r_squared"), rd("adj_r_squared", 8).alias("adj_r_squared"), "n")
