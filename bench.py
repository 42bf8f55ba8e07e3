"""Headline queries timed end to end; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the cores. A few queries run once untimed at the smallest size to load classes, then
each is timed over its whole tables; results are consumed without being collected.
The model queries, which fit at the study's sizes, are not in the list; the README has their times.
"""

from __future__ import annotations

import json
import os
import time

from isobar.plans.catalogue import QUERIES
from isobar.session import build_session

HEADLINE = [
    "nation_year_means",
    "star_enrich",
    "partition_prune",
    "merge_report",
    "obs_counts",
    "group_means",
    "location_aggregate",
    "height_ordered_means",
    "two_stage_mean",
    "daily_mean",
    "pivot_month",
    "rank_by_year",
    "time_delta",
    "top_temperature",
    "seeded_sample",
    "missing_overall",
    "missing_by_station",
    "bounds_check",
    "duplicate_report",
    "describe_skew",
    "coverage",
    "rolling_usage",
    "histogram50",
    "density",
    "box_by_station",
    "z_scores",
    "marker_table",
    "pearson_pairs",
    "spearman_matrix",
    "focused_pairs",
    "corr_by_month",
    "anova",
    "levene",
    "kruskal",
    "hypothesis_battery",
    "ols_cluster",
    "regression_comparison",
    "mean_baseline_metrics",
    "linear_metrics",
    "payload_unnest",
    "sidecar_reconcile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    names = [n for n in HEADLINE if n in QUERIES]

    def run(name: str, where: str) -> float:
        start = time.time()
        QUERIES[name].run(spark, where).write.format("noop").mode("overwrite").save()
        return time.time() - start

    if os.path.isdir(warm):
        for name in ("nation_year_means", "location_aggregate", "describe_skew", "pearson_pairs"):
            run(name, warm)
    times = {name: round(run(name, sf_dir), 3) for name in names}
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
