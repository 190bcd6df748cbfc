"""Headline telemetry queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

from tideglass.plans import registry
from tideglass.schemas import LOGS
from tideglass.sources.catalog import append, scan
from tideglass.sources.wal import Wal
from tideglass.streaming.ingest import Front, start

HEADLINE = (
    "summary_metrics", "latency_percentiles_dual", "latency_by_service_dual", "status_codes_dual", "log_histogram_minute", "log_histogram_12h_filled",
    "facets_one_scan", "error_page", "log_page", "service_health_class", "bench_filtered_scan", "bench_latency_by_service", "bench_hourly_error_rate",
    "filter_combined_two_arm", "metric_rollup", "replay_anti_join", "tumbling_window", "sql_window_rank", "sql_join_inner",
)
RUNS = 3
#: The ingest figures: batches of so many events, acknowledged after one sync for each group of batches.
BATCHES, EVENTS, GROUP = 40_000, 10, 400


def ingest(spark: SparkSession) -> dict[str, float]:
    """Events a second that the front acknowledges (each in the synced log), and that the stream then stores."""
    work = tempfile.mkdtemp(prefix="bench-ingest-")
    try:
        front = Front(f"{work}/landing", capacity=BATCHES * EVENTS, log=Wal(f"{work}/wal"))
        log = {"event_id": "", "timestamp_ns": 1_705_276_800_000_000_000, "level": "info", "message": "GET /api/orders took 12 ms", "logger_name": "app"}
        batches = [{"service_name": f"svc-{k % 5}", "logs": [log | {"event_id": f"evt-{k * EVENTS + i:020d}"} for i in range(EVENTS)]} for k in range(BATCHES)]
        began = time.perf_counter()
        taken = sum(a.events for at in range(0, BATCHES, GROUP) for a in front.accept_all(batches[at : at + GROUP]))
        accepted = taken / (time.perf_counter() - began)
        began = time.perf_counter()
        front.settle()
        start(spark, f"{work}/landing", f"{work}/store", f"{work}/checkpoint", once=True, front=front).awaitTermination()
        stored = scan(spark, f"{work}/store", "logs").count() / (time.perf_counter() - began)
        return {"acknowledged": round(accepted), "stored": round(stored)}
    finally:
        shutil.rmtree(work, ignore_errors=True)


def store_scan(spark: SparkSession, sf_dir: str) -> float:
    """Seconds for one service's last three days from a partitioned store, listing and pruning included."""
    work = tempfile.mkdtemp(prefix="bench-store-")
    try:
        append(registry.L(spark, sf_dir).select(*LOGS.names), work, "logs")
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            days = registry.q.by_day(scan(spark, work, "logs"), [registry.OneOf("service", ("svc-1",)), registry.Since(registry.NOW_MICROS - 3 * registry.DAY)])
            days.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        return round(median(runs[1:]), 4)
    finally:
        shutil.rmtree(work, ignore_errors=True)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for k in range(RUNS + 1):  # the first run compiles
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - began)
        took[name] = round(median(runs), 4)
    more = {"store_scan": store_scan(spark, sf_dir), "ingest_events_per_s": ingest(spark)}
    print(json.dumps({"metric": "telemetry queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")} | more))


if __name__ == "__main__":
    main()
