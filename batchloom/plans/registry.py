"""The registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions import display, fields
from batchloom.functions.canonical import canonical_batch_json
from batchloom.functions.contains import json_contains
from batchloom.operators import decode, leases, ledger, lookups, runs, validate
from batchloom.plans import inputs
from batchloom.plans.workspace import Workspace, workspace
from batchloom.sources import reports, synth, worker_log
from batchloom.sources.store import BUCKETS, EventStore
from batchloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the lookups.
PROJECT, NAME, ORG, FUNNEL, USER, BATCH_ID = "project_1", "click", "org_1", "signup_funnel", "7", "b7"
START_MS, END_MS = 1_704_240_000_000, 1_705_500_000_000
CLAIM_MS = 1_704_672_000_000
SINCE = "2024-01-10 00:00:00.5"
LIMIT = 25


def query(name: str):
    def register(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
        return build

    return register


def _as_text(df: DataFrame, *documents: str) -> DataFrame:
    return df.withColumns({d: F.to_json(d) for d in documents})


EVENT_COLUMNS = [
    "event_id", "name", "timestamp_ms", "project_id", "org_id", "funnel_id", "user_id", "anonymous_id",
    "session_id", "properties", "context", "received_at_ms",
]
STORED_COLUMNS = ["batch_id", "event_index", *EVENT_COLUMNS]


def _stored(events: DataFrame) -> DataFrame:
    return _as_text(events.select(*STORED_COLUMNS), "properties", "context")


def _decoded(ws: Workspace) -> DataFrame:
    return decode.decode_batches(ws.messages)


def _validated(ws: Workspace) -> DataFrame:
    return validate.validate_batches(_decoded(ws))


def _empty_ledger(ws: Workspace) -> DataFrame:
    return ws.ledger(None)


def _verdicts(ws: Workspace, stored: DataFrame) -> DataFrame:
    # Ledgers of ``ws.ledger`` have the buckets of a new store.
    return ledger.judge_contents(ledger.batch_contents(ws.accepted), stored, BUCKETS)


def _tagged(ws: Workspace, stored: DataFrame) -> DataFrame:
    return ledger.tag_deliveries(ws.accepted, _verdicts(ws, stored))


# Sources and sinks


@query("read_batch_messages")
def _(ws):
    return ws.messages.select("message_id", "message_order", "batch_id", "payload")


@query("decode_batch")
def _(ws):
    decoded = decode.decode_batches(inputs.batch_bodies(ws.messages), "body")
    return decoded.select("message_id", "batch_id", F.size("events").alias("total_events"), "decode_error")


@query("decode_event")
def _(ws):
    return decode.decode_events(inputs.event_bodies(ws.spark, ws.sf_dir)).select("event_id", "accepted", "reason")


@query("write_events")
def _(ws):
    return _stored(ws.twice_written.read(ws.spark, "events"))


@query("write_batch_ledger")
def _(ws):
    return ws.twice_written.read(ws.spark, "batches").select("batch_id", "payload_hash")


@query("append_batches")
def _(ws):
    path = ws.fresh("appended")
    ingest.append_batches(ws.message_stream, path, path + "-checkpoint").awaitTermination()
    appended = ws.spark.read.parquet(path)
    return appended.groupBy("batch_id").agg(
        F.count("*").alias("copies"), F.sum(F.size("events")).alias("events")
    )


def _report_columns(report: str = "") -> list[Column]:
    def at(name: str) -> Column:
        return F.col(f"{report}{name}")

    workers = at("workers")
    plain = [
        "batches", "batch_size", "requested_events", "submitted_bytes", "concurrency", "successful_requests",
        "failed_requests", "duration_seconds", "requests_per_second", "events_per_second",
    ]
    return [
        display.format_run_date(at("started_at")).alias("started"),
        display.format_run_date(at("finished_at")).alias("finished"),
        *[at(n).alias(n) for n in plain],
        *[at(f"latency_ms.{n}").alias(f"latency_{n}") for n in ("min", "p50", "p95", "p99", "max")],
        F.try_element_at(at("status_codes"), F.lit("202")).alias("status_202"),
        F.try_element_at(at("status_codes"), F.lit("500")).alias("status_500"),
        F.size(workers).alias("n_workers"),
        F.try_element_at(workers, F.lit("worker-3"))["processed"].alias("worker_3_processed"),
        F.try_element_at(workers, F.lit("worker-3"))["validated"].alias("worker_3_validated"),
    ]


@query("read_run_reports")
def _(ws):
    return ws.manifest.select("file", *_report_columns("report."))


@query("write_run_manifest")
def _(ws):
    path = ws.fresh("manifest")
    reports.write_run_manifest(ws.manifest, path)
    return reports.read_run_manifest(ws.spark, path).select("file", *_report_columns("report."))


@query("read_worker_log")
def _(ws):
    parsed = worker_log.log_fields(ws.worker_log, "run_id")
    return parsed.groupBy("run_id", display.epoch_millis(F.col("ts")).alias("ts_ms"), "worker_id", "msg").agg(
        F.count("*").alias("lines")
    )


@query("write_run_report")
def _(ws):
    path = ws.fresh("report")
    reports.write_run_reports(ws.run_reports(), path)
    return reports.read_run_reports(ws.spark, path).select("file", *_report_columns("report."))


@query("synth_batches")
def _(ws):
    numbers = inputs.source_events(ws.spark, ws.sf_dir).select(
        (F.col("event_id") + 1).alias("id"), display.epoch_millis(F.col("ts")).alias("now")
    )
    made = synth.synth_batches(numbers, 4, 0.3, F.col("now"))
    return made.select("batch_id", F.posexplode("events").alias("event_index", "e")).select(
        "batch_id", "event_index", "e.event", "e.timestamp", "e.projectid", "e.orgid", "e.funnelid",
        F.col("e.properties.sequence").alias("sequence"),
    )


# Projections, filters, predicates


@query("normalize_events")
def _(ws):
    flat = validate.flatten_events(_decoded(ws), "events", "message_id")
    return _as_text(
        flat.select("message_id", "batch_id", "event_index", *[F.col(f"event.{c}").alias(c) for c in EVENT_COLUMNS]),
        "properties", "context",
    )


@query("flatten_events")
def _(ws):
    flat = validate.flatten_events(_decoded(ws), "events", "message_id")
    return flat.select("message_id", "batch_id", "event_index", F.col("event.name").alias("name"))


@query("validate_event")
def _(ws):
    flat = validate.flatten_events(_decoded(ws), "events", "message_id")
    return flat.select("message_id", "event_index", validate.event_error(F.col("event")).alias("error"))


@query("validate_batch")
def _(ws):
    return _validated(ws).select("message_id", "batch_id", "reason")


@query("enforce_batch_limit")
def _(ws):
    return validate.enforce_batch_limit(_decoded(ws), LIMIT).select(
        "message_id", F.size("events").alias("total_events"), "admission_error"
    )


@query("filter_valid_events")
def _(ws):
    return validate.stored_rows(_validated(ws), "message_id").select(
        "message_id", "batch_id", "event_index", "name", "timestamp_ms"
    )


@query("rejected_events")
def _(ws):
    return validate.rejected_events(_validated(ws), "message_id")


@query("events_by_project_name")
def _(ws):
    return _stored(lookups.events_by_project_name(ws.table("events"), PROJECT, NAME))


@query("events_by_funnel")
def _(ws):
    return _stored(lookups.funnel_timeline(ws.table("events"), FUNNEL))


@query("events_by_properties")
def _(ws):
    return _stored(lookups.events_by_properties(ws.table("events"), {"k": 87}))


@query("events_by_properties_indexed")
def _(ws):
    """The same lookup over a store whose properties have postings."""
    return _stored(ws.indexed.find(ws.spark, {"k": 87}))


@query("events_by_org_time")
def _(ws):
    return _stored(lookups.events_by_org_time(ws.table("events"), ORG, START_MS, END_MS))


@query("events_by_user_time")
def _(ws):
    return _stored(lookups.events_by_user_time(ws.table("events"), USER))


@query("events_by_project_time")
def _(ws):
    return _stored(lookups.events_by_project_time(ws.table("events"), PROJECT, NAME, START_MS, END_MS))


@query("batch_by_id")
def _(ws):
    return lookups.batch_by_id(ws.table("batches"), BATCH_ID, ws.store.buckets(ws.spark))


@query("events_by_batch")
def _(ws):
    return _as_text(lookups.events_by_batch(ws.store.read_batch(ws.spark, BATCH_ID)), "properties")


@query("log_lines_since")
def _(ws):
    since = F.lit(SINCE).cast("timestamp")
    return runs.log_lines_since(ws.worker_log, since).select("run_id", F.col("value").alias("line"))


@query("search_runs")
def _(ws):
    """The shown start of the first run: some runs have it, not all."""
    shown = display.format_run_date(F.col("report.started_at"))
    text = ws.manifest.agg(F.min(shown)).first()[0]
    return runs.search_runs(ws.manifest, text).select("file")


@query("select_run")
def _(ws):
    asked = {
        "newest": None, "unknown": "stress-20000131-000000.000000000.json",
        "there": ws.manifest.agg(F.min("file")).first()[0],
    }
    found = [runs.select_run(ws.manifest, file).select(F.lit(name).alias("asked"), "file") for name, file in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


# Joins


@query("new_batches")
def _(ws):
    return ledger.new_batches(_verdicts(ws, _empty_ledger(ws)))


@query("new_events")
def _(ws):
    events = ws.table("events").select("batch_id", "event_index", "name")
    return ledger.new_events(events, events.filter(F.col("name") != NAME))


@query("batch_conflicts")
def _(ws):
    return _tagged(ws, _empty_ledger(ws)).filter("status = 'conflict'").select("message_id", "batch_id")


@query("conflict_places")
def _(ws):
    """Which events of a message in conflict differ from the first writer's."""
    found = ingest.quarantined_conflicts(ws.store, ws.spark)
    return found.select("message_id", "batch_id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


@query("batch_redeliveries")
def _(ws):
    return _tagged(ws, _empty_ledger(ws)).select("message_id", "batch_id", "status")


@query("orphan_events")
def _(ws):
    owners = ws.table("events").filter(F.col("event_index") == 0).filter(F.col("name") != NAME)
    return ledger.orphan_events(ws.table("events"), owners).select("batch_id", "event_index")


# Aggregations


@query("batch_validation_summary")
def _(ws):
    return validate.batch_results(_validated(ws), "message_id")


@query("stored_counts")
def _(ws):
    return lookups.stored_counts(ws.table("batches"), ws.table("events"))


@query("daily_event_counts")
def _(ws):
    """Counts merged from those of each of two epochs, the second of which brought copies and nothing else."""
    return ws.rolled_up.read_daily(ws.spark)


@query("status_code_counts")
def _(ws):
    return runs.status_code_counts(ws.requests)


@query("request_outcomes")
def _(ws):
    return runs.request_outcomes(ws.requests)


@query("latency_summary")
def _(ws):
    return runs.latency_summary(ws.requests)


@query("run_throughput")
def _(ws):
    return runs.run_throughput(ws.runs).select(
        "run_id", "duration_seconds", "requested_events", "requests_per_second", "events_per_second"
    )


@query("success_rate")
def _(ws):
    joined = ws.runs.select("run_id", "batches").join(runs.request_outcomes(ws.requests), "run_id")
    return joined.select("run_id", runs.success_rate(F.col("successful"), F.col("batches")).alias("success_rate"))


@query("worker_counts")
def _(ws):
    return runs.worker_counts(ws.worker_log)


@query("run_report")
def _(ws):
    return ws.run_reports().select("run_id", *_report_columns())


# Sorts


@query("funnel_timeline")
def _(ws):
    timeline = lookups.funnel_timeline(ws.table("events"), FUNNEL)
    return timeline.select("timestamp_ms", "batch_id", "event_index", "name", "user_id")


@query("runs_newest_first")
def _(ws):
    return runs.runs_newest_first(ws.manifest).select(
        display.format_run_date(F.col("report.started_at")).alias("started"), "file", "report.batches"
    )


@query("workers_by_name")
def _(ws):
    return runs.workers_by_name(runs.worker_counts(ws.worker_log))


# Scalar functions


@query("canonical_batch_json")
def _(ws):
    return _validated(ws).filter("reason IS NULL").select(
        "message_id", canonical_batch_json("batch_id", "valid_list").alias("canonical")
    )


@query("payload_hash")
def _(ws):
    hashed = validate.with_payload_hash(_validated(ws))
    return hashed.filter("reason IS NULL").select("message_id", "payload_hash")


@query("json_document")
def _(ws):
    flat = validate.flatten_events(_decoded(ws), "events", "message_id")
    properties, context = F.col("event.properties"), F.col("event.context")
    return flat.select(
        "message_id", "event_index",
        F.to_json(properties).alias("properties"), F.is_variant_null(properties).alias("no_properties"),
        F.to_json(context).alias("context"), F.is_variant_null(context).alias("no_context"),
    )


@query("json_contains")
def _(ws):
    events = inputs.source_events(ws.spark, ws.sf_dir).withColumn("doc", F.parse_json("props"))
    doc = F.col("doc")
    big, digit = "1234567890123456789", (F.col("event_id") % 10).cast("string")
    deep = F.concat(F.lit('{"list":[1,{"in":'), "props", F.lit('}],"big":' + big), digit, F.lit("}"))
    events = events.withColumn("deep", F.parse_json(deep))
    return events.select(
        "event_id",
        json_contains(doc, {"k": 87}).alias("number"),
        json_contains(doc, {"k": 87.0}).alias("same_number"),
        json_contains(doc, {"k": "87"}).alias("text"),
        json_contains(doc, {}).alias("object"),
        json_contains(doc, {"k": {}}).alias("nested"),
        json_contains(doc, {"missing": None}).alias("missing"),
        json_contains(F.col("deep"), {"list": [{"in": {"k": 87}}, 1]}).alias("in_array"),
        json_contains(F.col("deep"), {"big": int(big + "3")}).alias("big_number"),
    )


@query("zero_defaults")
def _(ws):
    flat = validate.flatten_events(_decoded(ws), "events", "message_id")
    return flat.select("message_id", "event_index", "event.event_id", "event.funnel_id", "event.received_at_ms")


@query("epoch_millis")
def _(ws):
    ms = display.epoch_millis(F.col("ts"))
    return inputs.source_events(ws.spark, ws.sf_dir).select(
        "event_id", ms.alias("ms"), display.format_run_date(display.from_epoch_millis(ms)).alias("shown")
    )


@query("format_run_date")
def _(ws):
    return inputs.source_events(ws.spark, ws.sf_dir).select(
        "event_id", display.format_run_date(F.col("ts")).alias("shown")
    )


@query("two_decimals")
def _(ws):
    value = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    return inputs.source_events(ws.spark, ws.sf_dir).select("event_id", display.two_decimals(value).alias("shown"))


@query("batch_label")
def _(ws):
    events = inputs.source_events(ws.spark, ws.sf_dir)
    return events.select(
        "event_id",
        display.batch_label(display.epoch_millis(F.col("ts")), F.col("event_id")).alias("label"),
        display.report_name(F.col("ts")).alias("report"),
    )


@query("log_fields")
def _(ws):
    return worker_log.log_fields(ws.worker_log).groupBy("worker_id", "msg").agg(
        F.count("*").alias("lines"),
        F.count("ts").alias("timed"),
        F.max(display.epoch_millis(F.col("ts"))).alias("last_ms"),
    )


@query("strict_json_field")
def _(ws):
    bodies = inputs.event_bodies(ws.spark, ws.sf_dir)
    raw = bodies.withColumn("f", F.expr(fields.json_fields("body")))
    checked = {
        "name": ("event", "text"), "timestamp_ms": ("timestamp", "integer"), "properties": ("properties", "object"),
    }
    columns = []
    for name, (key, kind) in checked.items():
        value = f"try_element_at(f, '{key}')"
        typed = fields.typed_field(value, kind)
        bad = fields.wrong_type(value, kind)
        shown = f"to_json({typed})" if kind == "object" else typed
        columns += [
            F.expr(f"CASE WHEN f IS NOT NULL AND NOT coalesce({bad}, false) THEN {shown} END").alias(name),
            F.expr(f"coalesce({bad}, false)").alias(f"bad_{name}"),
        ]
    return raw.select("event_id", *columns)


@query("lease_timeline")
def _(ws):
    return leases.lease_timeline(inputs.delivery_log(ws.spark, ws.sf_dir))


@query("claimable_messages")
def _(ws):
    timeline = leases.lease_timeline(inputs.delivery_log(ws.spark, ws.sf_dir))
    return leases.claimable_at(timeline, CLAIM_MS).select("message_id", "consumer", "delivered_ms", "claimable_ms")


# Streaming


@query("ingest_stream")
def _(ws):
    return _stored(ws.table("events"))


@query("stream_first_writer")
def _(ws):
    """Against a ledger that holds some ids already, one half of them with other contents."""
    group = F.expr("first.message_order div 10") % 10
    other = F.when(group == 5, F.sha2("payload_hash", 256)).otherwise(F.col("payload_hash"))
    contents = ledger.batch_contents(ws.accepted).filter(group.isin(0, 5))
    known = ws.ledger(contents.select("batch_id", other.alias("payload_hash")))
    return _tagged(ws, known).select("message_id", "batch_id", "status")


@query("replay_recovery")
def _(ws):
    """A stream, the same stream started again, and all its messages once more from a new stream."""
    store = EventStore(ws.fresh("replayed"))
    checkpoint = ws.fresh("replayed-checkpoint")
    for stream in (checkpoint, checkpoint, checkpoint + "-new"):
        ingest.drain(store, ws.message_stream, stream)
    return _stored(store.read(ws.spark, "events"))


@query("drain")
def _(ws):
    return ws.table("outcomes").select(
        "message_id", "batch_id", "status", "total_events", "valid_events", "invalid_events"
    )


@query("pending_messages")
def _(ws):
    acknowledged = ws.table("outcomes").filter(F.col("status").isin("new", "duplicate"))
    return ledger.pending_messages(ws.messages, acknowledged).select("message_id", "batch_id")


@query("quarantine")
def _(ws):
    return ws.table("quarantine").select("message_id", "batch_id", "reason", "payload")
