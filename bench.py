"""Times the headline queries: one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: local threads; BENCH_RUNS: measured runs (the median counts), after one warm-up."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from spanforge.plans import catalog

HEADLINE = (
    "slice_depth", "slice_pairs", "slice_order", "call_graph", "call_graph_args", "track_name_asof", "intern_encode", "intern_resolve", "compare_first_divergence", "compare_summary",
    "memory_normalize", "pc_hotspots", "pc_containing_function", "frame_expected_vs_actual", "frame_end_join", "flow_steps", "counter_series", "bin_strings_top", "bin_pattern_context", "codec_roundtrip",
)


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            t = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
