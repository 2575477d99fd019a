"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3). Every
query runs once to warm up, then BENCH_RUNS times into a noop sink, which computes whole rows; the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from trailpack.plans.catalogue import NATIVE

HEADLINE = (
    "training_inputs",
    "training_inputs_exploded",
    "training_inputs_default",
    "training_inputs_train_window",
    "training_inputs_orders",
    "histories",
    "histories_orders",
    "actions_union",
    "impression_items",
    "candidates_window",
    "quality_report",
    "leak_count",
    "history_audit",
    "upstream_same_day",
    "customer_snapshot",
    "reject_split",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            NATIVE[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
