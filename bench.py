"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEATS  timed runs per query after one warm-up, median reported (default 1)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from panelforge.plans import catalog
from panelforge.session import build_session

HEADLINE = [
    "wide_panel",
    "keep_latest_revision",
    "normalise_rows",
    "ingest_status",
    "duplicate_keys",
    "coverage_matrix",
    "validation_findings",
    "daily_reindex",
    "demand_lags",
    "rolling_statistics",
    "rolling_trend",
    "holiday_flags",
    "feature_matrix",
    "chronological_split",
    "fold_assignment",
    "guardrail",
    "three_way_comparison",
    "promotion_gate",
    "numeric_drift",
    "drift_summary",
    "quality_profile",
    "history",
    "scored_response",
    "describe_series",
    "monthly_seasonality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            # Small tables on one machine: window frames cost much time per byte.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    wanted = sys.argv[1:] or HEADLINE
    run(wanted[0])
    seconds = {}
    for name in wanted:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
