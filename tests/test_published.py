"""Published results re-derived from published location aggregates."""

import math

import pytest
from pyspark.sql import functions as F

from isobar.operators import correlation, geo, hypothesis, joins, regression, rollup

# Six coastal stations: id, name, lat, lon, elevation, observations, years,
# mean temperature, mean rain, annual rain over six years, mean wind, mean humidity.
STATIONS = [
    ("lk_batticaloa", "Batticaloa", 7.7102, 81.6924, 10.0, 52608, 6, 27.824260568734793, 0.19222551703163018, 1685.4333333333332, 2.4619563564476885, 77.03691453771289),
    ("lk_colombo", "Colombo", 6.9271, 79.8612, 9.0, 52608, 6, 26.89482778284672, 0.3111370894160584, 2728.0499999999997, 2.3980544784063262, 82.68715784671532),
    ("lk_galle", "Galle", 6.0535, 80.221, 3.0, 52608, 6, 26.816480383211676, 0.3160203771289538, 2770.8666666666663, 2.7445513990267636, 83.91465176399026),
    ("lk_jaffna", "Jaffna", 9.6615, 80.0255, 9.0, 52608, 6, 27.844103558394163, 0.17138458029197082, 1502.7, 5.897830558090025, 78.0997947080292),
    ("lk_matara", "Matara", 5.9549, 80.555, 6.0, 43848, 5, 26.87500228060573, 0.25413929939792007, 1857.25, 3.573100027367269, 83.84672048896186),
    ("lk_trincomalee", "Trincomalee", 8.5874, 81.2152, 9.0, 52608, 6, 27.76002128953771, 0.17748441301703163, 1556.1833333333334, 4.458194000912409, 75.78048965936739),
]
COLUMNS = (
    "location_id string, name string, latitude double, longitude double, elevation_m double, n long, years int, "
    "mean_temp double, mean_rain double, total_rain_per_year double, mean_wind double, mean_humidity double"
)


@pytest.fixture(scope="module")
def agg(spark):
    return spark.createDataFrame(STATIONS, COLUMNS)


def test_elevation_correlations(agg):
    got = correlation.height_relationships(
        agg, "elevation_m", ["mean_temp", "total_rain_per_year", "mean_wind", "mean_humidity"], "insufficient"
    )
    got = {r.variable: r for r in got.collect()}
    # R, p, rho, p.
    want = {
        "mean_temp": (0.7211070791259907, 0.10582557039194238, 0.819688599970537, 0.04583714123245327),
        "total_rain_per_year": (-0.5671274013008282, 0.24051248052953778, -0.5768179036829705, 0.23073225195460048),
        "mean_wind": (0.21774902439591162, 0.6785387089486375, -0.15179418517972906, 0.7740575031656568),
        "mean_humidity": (-0.7421432922853026, 0.09116266578703694, -0.819688599970537, 0.04583714123245327),
    }
    for name, (r, p, rho, ps) in want.items():
        row = got[name]
        assert row.n_locations == 6 and row.elevation_variation_status == "insufficient"
        for have, expected in ((row.pearson_r, r), (row.pearson_p, p), (row.spearman_r, rho), (row.spearman_p, ps)):
            assert math.isclose(have, expected, rel_tol=1e-9)


@pytest.mark.parametrize(
    "x, y, r, p, verdict",
    [
        ("elevation_m", "mean_temp", 0.7211070791259906, 0.10582557039194238, "FAIL TO REJECT H0"),
        ("elevation_m", "mean_rain", -0.6479426889396128, 0.16409876806782536, "FAIL TO REJECT H0"),
        ("elevation_m", "mean_wind", 0.21774902439591157, 0.6785387089486379, "FAIL TO REJECT H0"),
        ("latitude", "mean_temp", 0.887599442809332, 0.0182408000139868, "REJECT H0"),
    ],
)
def test_location_hypotheses(agg, x, y, r, p, verdict):
    row = hypothesis.location_correlation(agg, x, y, "t").first()
    assert math.isclose(row.statistic, r, rel_tol=1e-10)
    assert math.isclose(row.p_value, p, rel_tol=1e-9)
    assert row.conclusion == verdict


def test_clustered_regressions(agg):
    specs = {"one": (("elevation_m",), None), "three": (("elevation_m", "latitude", "longitude"), None)}
    fits = regression.fit_nested(agg, "mean_temp", specs, "location_id", weight="n")
    # Term, coefficient, standard error, p, lower and upper bound.
    want = {
        "one": [
            ("Intercept", 26.27446508059264, 0.230452157579034, 0.0, 25.822787151578186, 26.726143009607096),
            ("elevation_m", 0.13928400189026677, 0.03850450721054415, 0.00029764299119857545, 0.06381655451513742, 0.21475144926539613),
        ],
        "three": [
            ("Intercept", -1.39222856215779, 3.581719635178381, 0.6974951616563776, -8.41227004982736, 5.627812925511779),
            ("elevation_m", -0.004823659006720826, 0.00854014349350135, 0.572194994633622, -0.021562032676787548, 0.011914714663345895),
            ("latitude", 0.30027754195360756, 0.023153616031325184, 1.835836904395736e-38, 0.254897288420341, 0.34565779548687414),
            ("longitude", 0.3290288805149829, 0.044326108616242206, 1.1457140325031687e-13, 0.24215130405233762, 0.4159064569776282),
        ],
    }
    for label, rows in want.items():
        for have, expected in zip(fits[label].rows(), rows, strict=True):
            assert have[0] == expected[0]
            for a, b in zip(have[1:], expected[1:]):
                assert math.isclose(a, b, rel_tol=2e-6, abs_tol=1e-9), (label, have, expected)


def test_marker_colours_and_radius(agg):
    row = {r.tooltip: r for r in geo.marker_table(agg, "mean_temp", "name", F.col("name")).collect()}
    assert row["Galle"].fill_color == "#0030ff" and row["Galle"].radius == 10.0
    assert row["Jaffna"].fill_color == "#ff3000"
    assert math.isclose(row["Jaffna"].radius, 10 + (27.844103558394163 - 26.816480383211676) * 4)


def test_span_and_reference_order(spark, agg):
    assert geo.span_gate(agg, "elevation_m").first().status == "insufficient"
    ref = joins.location_reference(agg, agg.filter("name != 'Jaffna'"), "location_id", ["lk_galle"], "elevation_m")
    assert [(r.name, r.is_original) for r in ref.collect()] == [
        ("Galle", True),
        ("Matara", False),
        ("Colombo", False),
        ("Trincomalee", False),
        ("Batticaloa", False),
    ]


def test_annual_rain_with_both_denominators(spark, agg):
    """A station with five of six years: 1857.25 over all years, 2228.70 over its own."""
    yearly = agg.select("location_id", F.explode(F.sequence(F.lit(1), F.col("years"))).alias("year"), (F.col("total_rain_per_year") * 6 / F.col("years")).alias("rain"))
    for years, want in (("global", 1857.25), ("group", 2228.70)):
        out = rollup.location_aggregate(yearly, ["location_id"], {"m": "rain"}, {"total": "rain"}, years=years)
        assert math.isclose(out.filter("location_id = 'lk_matara'").first().total, want, rel_tol=1e-12)


def test_rank_table(spark):
    # Mean temperature order of 2025, one station absent.
    means = [("Batticaloa", 28.2), ("Jaffna", 28.1), ("Trincomalee", 28.0), ("Galle", 27.1), ("Colombo", 27.0)]
    df = spark.createDataFrame([(n, 2025, v) for n, v in means] + [("Matara", 2024, 27.0)], "name string, year int, t double")
    got = {r.name: r["2025"] for r in rollup.rank_by_period(df, "name", "year", "t", [2024, 2025]).collect()}
    assert got == {"Batticaloa": 1.0, "Jaffna": 2.0, "Trincomalee": 3.0, "Galle": 4.0, "Colombo": 5.0, "Matara": None}
