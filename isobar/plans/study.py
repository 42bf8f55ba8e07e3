"""The whole station study: raw partitions in, result tables out.

``enrich`` makes the analytical table once; every group below turns it into named
result tables. ``write_study`` runs all of them and stores each as CSV.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.functions.scalars import calendar, fixed_text
from isobar.operators import correlation, distribution, explain, geo, hypothesis, joins, models, quality, regression, rollup
from isobar.operators.ordered import present
from isobar.plans import constants as k
from isobar.session import prepare, settle
from isobar.sources import files, hive, sidecar

KEY, TS = "location_id", "timestamp"
Tables = dict[str, DataFrame]


def enrich(weather: DataFrame, locations: DataFrame) -> DataFrame:
    """Facts with station constants, calendar parts and season."""
    dim = locations.select(*k.DIMENSION_COLUMNS)
    return calendar(joins.join_checked(weather, dim, KEY), TS)


def ingest_tables(weather: DataFrame, locations: DataFrame, original: Sequence[str]) -> Tables:
    """File inventory, schema reports, counts, resolution, gaps and the station list."""
    feet = settle(files.footers(weather))
    keys = [KEY, "year"]
    parsed = sidecar.parse_sidecars(sidecar.read_documents(sidecar.sidecar_paths(weather)))
    measures = [c for c in weather.columns if c not in (KEY, "year", "year_partition", TS, "source_year", "ingested_at")]
    return {
        "file_inventory": files.file_inventory(feet, keys).drop("path"),
        "schema_consistency": files.schema_consistency(feet, keys).drop("path"),
        "schema_diffs": files.schema_diffs(feet, keys),
        "column_types": files.column_types(weather.drop(KEY, "year", "year_partition")),
        "obs_per_location": rollup.count_by(weather, KEY),
        "obs_per_year": rollup.count_by(weather, "year_partition"),
        "obs_per_location_year": rollup.count_by(weather, KEY, "year_partition"),
        "time_resolution": quality.common_deltas(weather, KEY, TS),
        "locations_raw": locations,
        "location_reference": joins.location_reference(locations, weather, KEY, original, "elevation_m", "is_original"),
        "source_summary": sidecar.flatten_sidecars(parsed),
        "source_mismatches": sidecar.reconcile(parsed, weather, keys, measures),
    }


def quality_tables(df: DataFrame, weather: DataFrame, first_year: int, last_year: int) -> Tables:
    present = [c for c in k.GAP_COLUMNS if c in df.columns]
    zero = [c for c in k.ZERO_COLUMNS if c in df.columns]
    report = joins.assert_merge(joins.merge_report(weather, df, KEY, TS, "latitude"))
    out = {
        "merge_summary": report,
        "missing_overall": quality.missing_overall(df),
        "missing_by_location": quality.missing_by_group(df, KEY, present),
        "missing_by_year": quality.missing_by_group(df, "year", present),
        "missing_by_month": quality.missing_by_group(df, "month", present),
        "duplicates": quality.duplicate_report(df, [KEY, TS]),
        "plausibility": quality.bounds_check(df, k.BOUNDS),
        "outside_years": quality.outside_years(df, TS, first_year, last_year),
        "positive_counts": quality.positive_counts(df, zero),
        "scale_profile": quality.table_profile(df, KEY, "year"),
    }
    for value, context in k.EXTREMES.items():
        out[f"top_{value}"] = rollup.top_rows(df, value, [KEY, TS, value, context], [KEY, TS])
    for gap in present[-2:]:
        out[f"gaps_by_year_{gap}"] = quality.missing_count_by_group(df, "year", gap)
    return out


def summary_tables(df: DataFrame, original: Sequence[str]) -> Tables:
    """Describe table, seasonality, season and location means, shapes."""
    by_name = lambda first, value: rollup.group_means(df, [first, "name"], [value]).orderBy(first, "name")
    means = rollup.group_means(df, [KEY, "name"], k.DESCRIBED, digits=2)
    monthly_rain = rollup.mean_of_totals(df, ["month", "name"], "year", "precipitation")
    heat = rollup.pivot_mean(df, KEY, "month", range(1, 13), "temperature_2m")
    return {
        "overall_summary": quality.describe(df, k.DESCRIBED),
        "annual_temperature": by_name("year", "temperature_2m"),
        "monthly_temperature": by_name("month", "temperature_2m"),
        "monthly_rainfall": monthly_rain.orderBy("month", "name"),
        "monthly_wind": by_name("month", "wind_speed_10m"),
        "season_summary": rollup.group_means(
            df, ["season"], ["temperature_2m", "precipitation", "wind_speed_10m", "relative_humidity_2m"], digits=2
        ).orderBy("season"),
        "location_summary": rollup.in_key_order(means, KEY, original),
        "location_month_temperature": rollup.in_key_order(heat, KEY, original),
        "histograms": distribution.histogram(df, k.DESCRIBED).orderBy("variable", "bin"),
        "densities": distribution.density(df, k.DESCRIBED).orderBy("variable", "x"),
        "box_standardised": distribution.box_stats(distribution.z_scores(df, k.DESCRIBED), k.DESCRIBED),
        "box_by_location": distribution.box_stats(
            df, ["temperature_2m", "precipitation", "wind_speed_10m", "relative_humidity_2m"], ["name"]
        ),
    }


def location_table(df: DataFrame, years: str = "group") -> DataFrame:
    return rollup.location_aggregate(
        df,
        [KEY, "name", "latitude", "longitude", "elevation_m"],
        {
            "mean_temp": "temperature_2m",
            "mean_rain": "precipitation",
            "mean_wind": "wind_speed_10m",
            "mean_humidity": "relative_humidity_2m",
            "mean_pressure": "pressure_msl",
        },
        {"total_rain_per_year": "precipitation"},
        years=years,
    )


def place_tables(df: DataFrame, years: str = "group") -> Tables:
    """Location aggregates, map data, elevation relationships and rank stability."""
    agg = settle(location_table(df, years))
    seen = [r[0] for r in df.select("year").distinct().orderBy("year").collect()]
    popup = fixed_text(
        "%s: elevation %.0f m, mean temperature %.2f C, mean annual rainfall %.0f mm, mean wind %.2f m/s, mean humidity %.1f %%",
        *[F.col(c) for c in ("name", "elevation_m", "mean_temp", "total_rain_per_year", "mean_wind", "mean_humidity")],
    )
    markers = geo.marker_table(agg, "mean_temp", "name", popup)
    status = geo.span_gate(agg, "elevation_m").first().status
    monthly = rollup.group_means(df, [KEY, "month"], ["temperature_2m"])
    monthly = rollup.attach_constants(monthly, agg, KEY, ["elevation_m"])
    variables = ["mean_temp", "total_rain_per_year", "mean_wind", "mean_humidity", "mean_pressure"]
    out = {
        "location_aggregates": agg,
        "elevation_summary": rollup.sorted_by(agg, "elevation_m", KEY),
        "elevation_span": geo.span_gate(agg, "elevation_m"),
        "elevation_correlations": correlation.height_relationships(agg, "elevation_m", variables, status),
        "elevation_corr_by_month": correlation.corr_by_group(monthly, "month", "elevation_m", "temperature_2m"),
        "temperature_rank_by_year": rollup.rank_by_period(df, "name", "year", "temperature_2m", seen),
        "gradients": geo.gradients(agg, ["latitude", "longitude"], ["mean_temp", "total_rain_per_year", "mean_wind"]),
        "map_centre": geo.map_centre(agg),
        "map_markers": markers,
        "map_features": geo.geojson_features(markers, ["tooltip", "radius", "fill_color", "popup"]),
        "location_year_means": rollup.means_with_counts(
            df,
            [KEY, "year"],
            {"mean_temp": "temperature_2m", "mean_precip": "precipitation", "mean_wind": "wind_speed_10m"},
        ),
    }
    for v in variables:
        out[f"elevation_line_{v}"] = distribution.fit_line(agg, "elevation_m", v)
    if status == "sufficient":
        out["elevation_groups"] = geo.tertile_means(agg, "elevation_m", ["mean_temp", "total_rain_per_year", "mean_wind"])
    return out


def inference_tables(df: DataFrame) -> Tables:
    """Correlation matrices, focused pairs, hypothesis tests and regressions."""
    spark = df.sparkSession
    place = ("elevation_m", "latitude", "longitude")
    specs = {
        "1: Elevation only": (place[:1], None),
        "2: + Lat/Lon": (place, None),
        "3: + Month + Year": ((*place, "year"), "month"),
    }
    fits = regression.fit_nested(df, "temperature_2m", specs, KEY)
    names = list(dict.fromkeys(c for pair in k.FOCUS_PAIRS for c in pair))
    constants = [c for c in names if c in place]
    level = df.groupBy(KEY).agg(
        *[F.min(c).alias(c) for c in constants], *[F.avg(c).alias(c) for c in names if c not in constants]
    )
    out = {
        "pearson_matrix": correlation.matrix_form(correlation.pearson_pairs(df, k.CORRELATED), k.CORRELATED),
        "spearman_matrix": correlation.matrix_form(correlation.spearman_all_pairs(df, k.CORRELATED), k.CORRELATED),
        "focused_pairs": correlation.focused_pairs(df, k.FOCUS_PAIRS),
        "location_level_pairs": correlation.location_pairs(level, k.FOCUS_PAIRS),
        "hypothesis_tests": hypothesis.battery(
            df,
            KEY,
            TS,
            compare={"H1_temperature_by_location": "temperature_2m"},
            ranks={"H2_rainfall_by_location": "precipitation"},
            relations={
                "H3_elevation_temperature": ("elevation_m", "temperature_2m"),
                "H4_elevation_rainfall": ("elevation_m", "precipitation"),
                "H5_elevation_wind": ("elevation_m", "wind_speed_10m"),
                "H6_latitude_temperature": ("latitude", "temperature_2m"),
            },
        ),
        "regression_comparison": regression.comparison(spark, fits, "elevation_m"),
    }
    for label, fit in fits.items():
        out[f"coefficients_model{label[0]}"] = fit.table(spark)
    fitted = distribution.residuals(fits["3: + Month + Year"].predict(df), "temperature_2m", "fitted")
    out["actual_against_fitted"] = distribution.binned_scatter(fitted, "fitted", "temperature_2m", 0.25, 0.25)
    out["residual_against_fitted"] = distribution.binned_scatter(fitted, "fitted", "residual", 0.25, 0.25)
    return out


def model_tables(
    df: DataFrame,
    last_train: int,
    sizes: models.Sizes = models.Sizes(),
    space: dict[str, list] = models.FOREST_SPACE,
    draws: int = 10,
    folds: int = 4,
) -> Tables:
    """Model comparison, tuning, errors by location and three importance measures."""
    train, test = models.time_split(models.model_features(df, TS), "year", last_train)
    keys = [KEY, TS]
    fitted = models.fit_models(train, k.FEATURES, k.TARGET, sizes)
    search = models.random_search(train, k.FEATURES, k.TARGET, TS, draws, folds, space, sizes)
    fitted.models["Random Forest (tuned)"] = search.model
    mean = present(train, [k.TARGET]).agg(F.avg(k.TARGET)).first()[0]
    scored, names = fitted.score(test, mean, ["name"])
    comparison = settle(models.evaluate(scored, "label", names))
    untuned = comparison.filter("Model != 'Random Forest (tuned)'")
    best = rollup.best_by(untuned, "Model", "RMSE").first().Model
    chosen = distribution.residuals(scored, "label", names[best])
    plain = fitted.models["Random Forest"]
    return {
        "model_comparison": comparison,
        "best_model": rollup.best_by(untuned, "Model", "RMSE"),
        "tuning_summary": models.tuning_summary(plain, search, test, k.FEATURES, k.TARGET),
        "error_by_location": models.error_by_group(scored, "name", "label", names[best]),
        "predicted_against_actual": distribution.binned_scatter(chosen, "label", names[best], 0.25, 0.25),
        "feature_importance": explain.impurity_importance(search.model, k.FEATURES, test),
        "permutation_importance": explain.permutation_importance(search.model, test, k.FEATURES, k.TARGET, keys),
        "shapley_mean_abs": explain.shapley_mean_abs(search.model, test, k.FEATURES, k.TARGET, keys),
    }


def write_study(
    spark: SparkSession,
    weather_root: str,
    locations_path: str,
    out: str,
    original: Sequence[str],
    first_year: int,
    last_year: int,
    sizes: models.Sizes = models.Sizes(),
    space: dict[str, list] = models.FOREST_SPACE,
    draws: int = 10,
    folds: int = 4,
) -> list[str]:
    """Run every table group and write ``out/<table>`` as CSV; returns the names.

    The enriched table is stored once below ``out`` and all later groups read that
    copy, partitioned by location and year.
    """
    prepare(spark)
    weather = hive.read_observations(spark, weather_root)
    locations = hive.read_locations(spark, locations_path)
    analytical = f"{out}/analytical"
    hive.write_table(enrich(weather, locations), analytical, [KEY, "year"])
    df = hive.read_tree(spark, analytical, year_alias=None)
    written = []
    groups = [
        lambda: ingest_tables(weather, locations, original),
        lambda: quality_tables(df, weather, first_year, last_year),
        lambda: summary_tables(df, original),
        lambda: place_tables(df),
        lambda: inference_tables(df),
        lambda: model_tables(df, last_year - 1, sizes, space, draws, folds),
    ]
    for group in groups:
        for name, table in group().items():
            if name == "map_features":
                table.write.mode("overwrite").text(f"{out}/{name}")
            else:
                hive.write_csv(table, f"{out}/{name}", single=True)
            written.append(name)
    return written
