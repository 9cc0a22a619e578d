"""Times the headline queries over whole tables and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, BENCH_CPUS (default all)
the number of local cores. Each query is written to Spark's no-op sink, so every
row and column of its result is computed. BENCH_QUERIES (comma-separated) narrows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import corpora  # noqa: E402
from checks.queries import queries  # noqa: E402
from srcmetrics.options import ScanOptions  # noqa: E402
from srcmetrics.plans.scan import scan  # noqa: E402

HEADLINE = [
    "file_loc",
    "lines",
    "span_loc",
    "select_files",
    "detect_language",
    "scan_detected",
    "ignore_rules",
    "scan_status",
    "rust_functions",
    "csharp_callables",
    "csharp_top_level",
    "top_functions",
    "offending_files",
    "json_files",
    "tree_report",
    "ordered_files",
    "scan",
]


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one job a user runs: selection, definitions and totals of the Rust corpus."""
    return scan(corpora.rust_files(spark, sf_dir), ScanOptions(language="rust")).items


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("srcmetrics-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus * 2))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries() | {"scan": _scan}
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executors
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
