"""Metrics of load-test runs and the run catalog.

A request row is one attempted request: ``run_id``, ``latency_ms``, ``status`` (NULL = no response) and
``body_bytes``. A run row holds what was asked for: times, url, number and size of batches, concurrency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions import display, logfields
from batchloom.operators.ranks import value_at_rank
from batchloom.operators.spread import lookup_join
from batchloom.schemas import PROCESSED_LINE, VALIDATED_LINE

LATENCY_RATIOS = [0.50, 0.95, 0.99]


def _per_status(requests: DataFrame) -> DataFrame:
    """Requests and body bytes per run and status: a few rows per run, whatever its size."""
    return requests.groupBy("run_id", "status").agg(F.count("*").alias("n"), F.sum("body_bytes").alias("bytes"))


def _outcome_columns() -> list[Column]:
    answered = F.col("status").isNotNull()
    success = F.coalesce(F.col("status").try_cast("int").between(200, 299), F.lit(False))
    return [
        F.sum("n").alias("attempts"),
        F.sum(F.when(success, F.col("n")).otherwise(0)).alias("successful"),
        F.sum(F.when(success, 0).otherwise(F.col("n"))).alias("failed"),
        F.sum(F.when(answered, F.col("bytes")).otherwise(0)).alias("submitted_bytes"),
    ]


def status_code_counts(requests: DataFrame) -> DataFrame:
    """Responses per status code; requests without a response are not counted."""
    return _per_status(requests.filter("status IS NOT NULL")).select("run_id", "status", "n")


def request_outcomes(requests: DataFrame) -> DataFrame:
    """Attempts, successes (200-299), failures (all else) and bytes of the answered requests."""
    return _per_status(requests).groupBy("run_id").agg(*_outcome_columns())


def latency_summary(requests: DataFrame) -> DataFrame:
    """min, p50, p95, p99 and max latency over all attempts of a run, answered or not."""
    ranked = value_at_rank(requests, ["run_id"], "latency_ms", LATENCY_RATIOS)
    return ranked.select("run_id", F.col("low").alias("min"), "p50", "p95", "p99", F.col("high").alias("max"))


def duration_seconds(started: Column, finished: Column) -> Column:
    seconds = (F.unix_micros(finished) - F.unix_micros(started)) / F.lit(1e6)
    return F.when(seconds == 0, F.lit(0.000001)).otherwise(seconds)


def run_throughput(runs: DataFrame) -> DataFrame:
    """Requests and events per second of what was asked for, over the run's whole duration."""
    return (
        runs.withColumn("duration_seconds", duration_seconds(F.col("started_at"), F.col("finished_at")))
        .withColumn("requested_events", F.col("batches") * F.col("batch_size"))
        .withColumn("requests_per_second", F.col("batches").cast("double") / F.col("duration_seconds"))
        .withColumn("events_per_second", F.col("requested_events").cast("double") / F.col("duration_seconds"))
    )


def success_rate(successful: Column, batches: Column) -> Column:
    """Percentage of the requested batches that succeeded, 0 when none was requested."""
    return F.when(batches == 0, F.lit(0.0)).otherwise(successful.cast("double") / batches * 100)


def log_lines_since(lines: DataFrame, since: Column | None) -> DataFrame:
    """Lines whose time parses and is not before ``since``; without ``since`` all lines.

    Log times have whole seconds, so with a sub-second ``since`` the lines of that second are dropped.
    """
    if since is None:
        return lines
    return lines.filter(logfields.log_time(F.col("value")) >= since)


def worker_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """Processed and validated batches per worker; a worker with other lines only counts 0 and 0."""
    line = F.col("value")
    return (
        lines.withColumn("worker_id", logfields.worker_id(line))
        .filter("worker_id IS NOT NULL")
        .groupBy(*keys, "worker_id")
        .agg(
            F.count_if(line.contains(PROCESSED_LINE)).alias("processed"),
            F.count_if(line.contains(VALIDATED_LINE)).alias("validated"),
        )
    )


def worker_counts_of_runs(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run and worker, counting the lines of the run's log from the run's start on."""
    starts = runs.select("run_id", "started_at")
    # Equal lines of a hot run must not share a salt: spread by place, not by text.
    placed = lines.withColumn("place", F.monotonically_increasing_id())
    started = lookup_join(placed, starts, ["run_id"], F.col("place")).drop("place")
    return worker_counts(log_lines_since(started, F.col("started_at")), "run_id")


def workers_by_name(counts: DataFrame) -> DataFrame:
    return counts.orderBy("worker_id")


def run_report(runs: DataFrame, requests: DataFrame, workers: DataFrame) -> DataFrame:
    """One report row per run. Everything joined here is already one row per run.

    A report holds a map of its status codes and one of its workers, so their number is bounded by what one row holds.
    A run without log lines has no workers (NULL).
    """
    code = F.when(F.col("status").isNotNull(), F.struct("status", F.col("n").cast("bigint")))
    answers = _per_status(requests).groupBy("run_id").agg(
        *_outcome_columns(), F.map_from_entries(F.collect_list(code)).alias("status_codes")
    )
    by_worker = workers.groupBy("run_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "worker_id",
                    F.struct(F.col("processed").cast("bigint"), F.col("validated").cast("bigint")),
                )
            )
        ).cast("map<string,struct<processed:bigint,validated:bigint>>").alias("workers")
    )
    latency = latency_summary(requests).select(
        "run_id", F.struct("min", "p50", "p95", "p99", "max").alias("latency_ms")
    )
    no_latency = F.struct(*[F.lit(0.0).alias(n) for n in ("min", "p50", "p95", "p99", "max")])
    joined = (
        run_throughput(runs)
        .join(answers, "run_id", "left")
        .join(latency, "run_id", "left")
        .join(by_worker, "run_id", "left")
    )
    return joined.select(
        "run_id",
        "started_at",
        "finished_at",
        "url",
        F.col("batches").cast("bigint").alias("batches"),
        F.col("batch_size").cast("bigint").alias("batch_size"),
        F.col("requested_events").cast("bigint").alias("requested_events"),
        F.coalesce("submitted_bytes", F.lit(0)).cast("bigint").alias("submitted_bytes"),
        F.col("concurrency").cast("bigint").alias("concurrency"),
        F.coalesce("successful", F.lit(0)).cast("bigint").alias("successful_requests"),
        F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed_requests"),
        F.coalesce("status_codes", F.create_map().cast("map<string,bigint>")).alias("status_codes"),
        "duration_seconds",
        "requests_per_second",
        "events_per_second",
        F.coalesce("latency_ms", no_latency).alias("latency_ms"),
        "workers",
    )


def runs_newest_first(manifest: DataFrame) -> DataFrame:
    """Newest start first; ties by file name."""
    return manifest.orderBy(F.desc("report.started_at"), "file")


def search_runs(manifest: DataFrame, text: str) -> DataFrame:
    """Runs whose displayed start date holds the text, in any letter case."""
    shown = F.lower(display.format_run_date(F.col("report.started_at")))
    return manifest.filter(shown.contains(text.lower()))


def select_run(manifest: DataFrame, file: str | None = None) -> DataFrame:
    """The run of that file; without a file, or for one that is not there, the newest run."""
    asked = F.lit(False) if file is None else F.col("file") == file
    return manifest.orderBy(asked.desc(), F.desc("report.started_at"), "file").limit(1)
