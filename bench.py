"""Time the headline queries and print one JSON line.

Every query runs once to warm up and then BENCH_REPEATS times (default 3); the median counts.
Results go to Spark's no-op sink, so all rows are computed and none are collected.
"""

import json
import os
import statistics
import time

import pyspark

from suite.queries import QUERIES
from suite.session import local_session

HEADLINE = [
    "stg_trips",
    "reject_reasons",
    "fct_trips",
    "unmatched_zones",
    "daily_metrics",
    "zone_metrics",
    "monthly_metrics",
    "zone_monthly_growth",
    "quality_report",
    "audit_rows",
    "refs_not_in",
    "unique_keys",
    "group_completeness",
    "uniform_within_group",
    "delete_insert",
    "overwrite_range",
    "touched_dates",
    "missing_days",
    "day_ranges",
    "multiset_diff",
    "positional_mismatches",
    "table_checksum",
    "build_counts",
    "restated_monthly",
    "logic_change_diff",
    "prod_unchanged",
    "stream_daily",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session("bench", cpus)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "lineitem_rows": lines,
                "full_build_rows_per_sec": round(lines / seconds["build_counts"]),
                "cpus": cpus,
                "repeats": repeats,
                "session": "warm",
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
                "spark": pyspark.__version__,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
