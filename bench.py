"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4),
BENCH_RUNS (default 3 timed runs after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from registry import QUERIES  # noqa: E402

HEADLINES = (
    "simple_aggregate",
    "gold_group_stats",
    "gold_group_stats_spread",
    "gold_analytics",
    "column_stats",
    "schema_discovery",
    "dq_duplicate_rows",
    "dq_report",
    "role_transform",
    "monthly_series",
    "growth_trend",
    "yoy_growth",
    "ranking",
    "breakdown",
    "cross_breakdown",
    "contributors",
    "filtered_series",
    "question_intent",
    "question_filters",
    "incremental_appended",
    "stream_quality_counts",
    "medallion_run",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="orefold-bench-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_once(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    seconds = {}
    for name in HEADLINES:
        run_once(spark, name, sf_dir)
        timed = [run_once(spark, name, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(timed), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_of_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
