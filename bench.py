"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from casekit.checks.registry import QUERIES
from casekit.checks.tables import cases
from casekit.session import local_session

HEADLINE = (
    "filtered_group_agg", "agg_sum", "agg_median", "agg_nunique", "describe_by_group", "correlation_matrix",
    "hierarchy_rollup", "outlier_filter_iqr", "business_key_duplicates", "iqr_outliers", "column_profile",
    "clean_table", "fuzzy_value_match", "text_search", "category_breakdown", "officer_productivity", "monthly_trend",
    "hierarchy_risk", "kpi_table", "executive_kpis", "executive_deltas", "hierarchy_anomalies", "pareto_hotspots",
    "pareto_hierarchy", "chart_histogram", "rolling_average_daily_grouped", "growth_mom", "flow_links", "risk_matrix",
    "performance_matrix", "geo_resolve", "insight_trend",
)


def run(query, spark, sf_dir) -> float:
    """Seconds to compute every row and column of the result without bringing it to the driver."""
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cpus, "casekit-bench")
    start = time.perf_counter()
    cases(spark, sf_dir).count()
    staging = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in HEADLINE:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "staging_sec": staging, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
