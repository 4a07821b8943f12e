"""Times every registered query, and the ingest of five synthetic loads; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of cores. Queries are timed on their second run,
with the result computed in full and thrown away; those that write a store of their own run once. Tables that several
queries share are made once; that time is part of the total.
"""

from __future__ import annotations

import json
import os
import platform
import sys
import time

from pyspark.sql import SparkSession

from batchloom import schemas as S
from batchloom.plans.registry import QUERIES
from batchloom.plans.workspace import workspace
from batchloom.session import configure
from batchloom.sources.store import EventStore
from batchloom.sources.synth import batch_numbers, synth_batches, synth_messages
from batchloom.streaming.ingest import process_epoch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]

# The load shapes as (batches, events per batch, rate of invalid events).
LOADS = {
    "smoke": (100, 10, 0.0),
    "default": (1_000, 10, 0.0),
    "visual_report": (1_000, 25, 0.0),
    "mixed_validity": (5_000, 50, 0.10),
    "throughput": (10_000, 100, 0.0),
}
RUN_ONCE = {"replay_recovery", "write_run_report"}


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def compute(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared = workspace(configure(spark), SF_DIR)
    setup = {
        "land_messages": seconds(lambda: shared.messages_path),
        "ingest_store": seconds(lambda: shared.store),
        "write_twice": seconds(lambda: shared.twice_written),
        "run_tables": seconds(lambda: (shared.accepted, shared.reports_path)),
    }

    times = {}
    for name, query in QUERIES.items():
        if ONLY and name not in ONLY:
            continue
        if name not in RUN_ONCE:
            compute(query(spark, SF_DIR))
        times[name] = seconds(lambda: compute(query(spark, SF_DIR)))

    loads = {}
    store = EventStore(shared.fresh("load")).create(spark)
    for epoch, (name, (batches, size, rate)) in enumerate([] if ONLY else LOADS.items()):
        path = shared.fresh(f"load-{name}")
        made = synth_batches(batch_numbers(spark, batches), size, rate, 1_767_225_600_000 + epoch)
        synth_messages(made).write.parquet(path)
        messages = spark.read.schema(S.MESSAGE).parquet(path)
        took = seconds(lambda: process_epoch(store, messages, epoch))
        loads[name] = {"events": batches * size, "sec": took, "events_per_sec": round(batches * size / took)}

    line = {
        "metric": "total seconds of all registered event queries and their shared set-up",
        "value": round(sum(times.values()) + sum(setup.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "setup": setup,
        "loads": loads,
        "hardware": f"local[{CPUS}], {platform.machine()}, {os.cpu_count()} cores",
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    sys.exit(main())
