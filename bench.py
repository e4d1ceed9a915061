"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default all).
Every query is planned and run to the end with its rows discarded; the figure is the median of
``BENCH_RUNS`` runs (default 3) after one warm-up. Queries that write windows run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.queries import all_queries

REPEATED = [
    "window_counts",
    "window_toplist",
    "words_toplist",
    "topk_current",
    "topk_range",
    "topk_range_truncated",
    "topk_range_open",
    "sales_topk",
    "topk_approx",
    "monitored_list",
    "distinct_range_exact",
    "distinct_range_hll",
    "hll_accuracy",
    "kmv_distinct",
    "cms_cells",
    "cms_estimate",
    "values_first_seen",
    "value_and_count",
    "value_and_count_sketch",
    "all_collections",
    "window_arrival_order",
    "config_toplist",
    "log_tokens",
    "import_filtered",
    "export_tagged",
    "labels_total",
    "key_canonical",
    "pack_values",
    "parse_values",
]
# The first of these also writes the store that the others read.
STORED = [
    "stored_catalog",
    "stored_topk_range",
    "stored_topk_truncated",
    "stored_distinct",
    "stored_value_and_count",
]
ONCE = ["seal_write_once", "stream_windows", "stream_open_window", "stream_labels"]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session()
    queries = all_queries()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or REPEATED + STORED + ONCE:
        times = []
        for _ in range(1 if name in ONCE else runs + 1):
            began = time.perf_counter()
            run(queries[name](spark, sf_dir))
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
