"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
BENCH_QUERIES comma-separated query names, instead of the headline list
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tributary.plans.queries import QUERIES
from tributary.session import configure

HEADLINE = (
    "latest_by_key",
    "dedup_lineitem",
    "key_check",
    "clean_customers",
    "clean_transactions",
    "clean_user_sessions",
    "clean_campaigns",
    "clean_impressions",
    "title_case",
    "customer_summary",
    "customer_summary_exact",
    "campaign_summary",
    "campaign_summary_by_conversion",
    "cdc_apply",
    "csv_scan",
    "table_loads",
    "stream_ingest_latest",
    "cdc_apply_stream",
    "file_arrivals",
    "append_loads",
    "snapshot_replace",
    "refresh_customer_summary",
)


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Time from calling the query to its last row, with every column computed."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        seconds(spark, name, sf_dir)
        timings[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
