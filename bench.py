"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginalia.plans.registry import QUERIES  # noqa: E402
from marginalia.sources.corpora import corpus  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Query -> the corpus whose files and lines it works through.
HEADLINES = {
    "part_tokens": "src_part",
    "part_comments": "src_part",
    "prune": "src_part",
    "clean": "src_part",
    "strict_prune": "src_part",
    "prune_bulk": "src_order",
    "density_bulk": "src_order",
    "page_prune": "pages_html",
    "page_density": "pages_html",
    "splice": "src_order",
    "annotate_overwrite": "src_order",
    "accepted_items": None,
    "change_kind": "rev_part",
    "verify_roundtrip": "src_order",
    "payload_audit": "src_order",
    "quarantine": "src_order",
    "explicit_deletions": "src_part",
    "annotate_offline": "src_part",
}
TABLES = ("part", "orders", "lineitem", "pages")


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def in_files(spark: SparkSession) -> str:
    """The tables as folders of several files, as any large table is; each has one row group here,
    which one task would read."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        table.repartition(2 * int(CPUS)).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = in_files(spark)
    sizes = {}
    for name in sorted({c for c in HEADLINES.values() if c}):
        text = F.col("content")
        n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        sizes[name] = corpus(spark, sf_dir, name).agg(F.count("*"), F.sum(n_lines)).first()

    times, rates = {}, {}
    for name, source in HEADLINES.items():
        # The whole result is produced but not stored. The better of two runs counts, so
        # that start-up of the JVM does not drown the small scale factors.
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        times[name] = round(min(seconds(run), seconds(run)), 3)
        if source:
            files, lines = sizes[source]
            rates[name] = {
                "files_per_sec": round(files / times[name]),
                "lines_per_sec": round(lines / times[name]),
            }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": SF_DIR.rstrip("/").rpartition("sf")[2],
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
