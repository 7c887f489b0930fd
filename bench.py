"""Time the headline queries; prints one JSON line."""

import json
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ferrowatch.plans import catalogue
from ferrowatch.sources.staging import release

HEADLINES = [
    "sensor_continuity",
    "sensor_frequency",
    "operational_report",
    "corrected_hours",
    "maintenance_report",
    "duplicate_counts",
    "id_consistency",
    "integrated",
    "summary_stats",
    "missing_report",
    "frequencies",
    "outliers",
    "correlations",
    "features",
    "alert_percentages",
    "detailed_alert_percentages",
    "score_distribution",
    "item_thresholds",
    "item_percentages",
    "metrics_on_rule",
]


def session(cpus: str) -> SparkSession:
    shared = Path(os.environ.get("BENCH_SHARED", "/tmp")) / f"ferrowatch-bench-{uuid.uuid4().hex}"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ferrowatch-bench")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    plans = catalogue.queries()
    # Untimed queries, one of them with many joins, start the threads and fill the code cache.
    for name in ("sensor_ranges", "integrated"):
        plans[name](spark, directory).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        # The whole result is computed, and none of it is brought to the driver.
        plans[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release(spark)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(directory).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
