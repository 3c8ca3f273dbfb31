"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from eventloom import entries

HEADLINE = ["flagship", "agg_avg", "agg_expr", "agg_multi_group", "agg_over_week", "compute_multi_metric", "filter_multi", "derive_project", "alerts_truthy", "simulate_delta", "enrich_left_join", "view_metric_series", "heatmap", "streaks", "validate_events"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = entries.queries(), {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):  # the first one warms up
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline queries, median of warm runs, summed", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
