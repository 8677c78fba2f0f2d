"""Times the headline queries: python bench.py prints one JSON line.

``$BENCH_SF_DIR`` is the data (default sf0.1), ``$BENCH_CPUS`` the local cores.
Every query runs to a no-op sink, so results are computed but not collected; the
time shown is the better of two runs after the session is warm.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from fleetstats.catalog import QUERIES

HEADLINE = [
    "wait_pareto", "top_waits", "reads_by_database", "costly_by_io", "costly_by_cpu",
    "most_blocked", "most_expensive_logical_reads", "worst_procedures", "missing_index_plans",
    "page_query_stats", "cache_pollution", "cache_pollution_details", "lowest_plan_reuse",
    "missing_indexes_with_rows", "index_used_flag", "fragmented_indexes", "partitioned_tables",
    "file_latency", "buffer_by_object", "buffer_by_database", "disk_usage_by_index", "last_backup",
    "resource_fit", "pareto_customers", "running_order_total", "share_of_segment",
    "top_orders_per_customer", "customer_deadlock_tails", "aggregate_locks", "number_locks",
    "lock_overview",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fleetstats-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
