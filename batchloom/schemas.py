"""Fixed schemas and fixed texts."""

from __future__ import annotations

from pyspark.sql import types as T

# Wire keys of one event, in the order in which the canonical text writes them, with the
# stored column each becomes and its JSON kind.
EVENT_FIELDS = [
    # wire key, stored column, kind
    ("id", "event_id", "text"),
    ("event", "name", "text"),
    ("timestamp", "timestamp_ms", "integer"),
    ("received_at", "received_at_ms", "integer"),
    ("projectid", "project_id", "text"),
    ("orgid", "org_id", "text"),
    ("funnelid", "funnel_id", "text"),
    ("user_id", "user_id", "nullable text"),
    ("anonymous_id", "anonymous_id", "nullable text"),
    ("session_id", "session_id", "nullable text"),
    ("properties", "properties", "object"),
    ("context", "context", "object"),
]

# Reasons a message, a batch or an event is turned away.
BAD_ENVELOPE_ID = "message has invalid batch_id"
BAD_ENVELOPE_PAYLOAD = "message has invalid payload"
BAD_ENVELOPE = "message is not a JSON object"
INVALID_JSON = "invalid JSON"
NAME_REQUIRED = "Event name is required!"
TIMESTAMP_REQUIRED = "Timestamp is required!"
PROJECT_REQUIRED = "Project ID required!"
ORGANIZATION_REQUIRED = "Organization ID required!"
OVER_LIMIT = "Batch exceeds maximum event limit"
MISSING_BATCH_ID = "Batch Validation Failed: Missing Batch ID"
EMPTY_BATCH = "Batch Validation Failed: Empty Batch"
NO_VALID_EVENTS = "Batch contains no valid events"
CONFLICT = "batch already exists with different contents"

# Messages that the worker log lines carry.
PROCESSED_LINE = "Worker processed batch"
VALIDATED_LINE = "Worker validated batch"

MESSAGE = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("message_order", T.LongType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("payload", T.StringType()),
])

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("received_at_ms", T.LongType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("funnel_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("anonymous_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("properties", T.VariantType()),
    T.StructField("context", T.VariantType()),
])

EVENTS = T.StructType(
    [T.StructField("batch_id", T.StringType()), T.StructField("event_index", T.IntegerType())]
    + EVENT.fields
    + [T.StructField("created_at", T.TimestampType())]
)

BATCHES = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("payload_hash", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

OUTCOMES = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("payload_hash", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_events", T.IntegerType()),
    T.StructField("valid_events", T.IntegerType()),
    T.StructField("invalid_events", T.IntegerType()),
])

QUARANTINE = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("payload", T.StringType()),
])

LATENCY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("min", "p50", "p95", "p99", "max")])

WORKER_STATS = T.StructType([
    T.StructField("processed", T.LongType()),
    T.StructField("validated", T.LongType()),
])

REPORT = T.StructType([
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("url", T.StringType()),
    T.StructField("batches", T.LongType()),
    T.StructField("batch_size", T.LongType()),
    T.StructField("requested_events", T.LongType()),
    T.StructField("submitted_bytes", T.LongType()),
    T.StructField("concurrency", T.LongType()),
    T.StructField("successful_requests", T.LongType()),
    T.StructField("failed_requests", T.LongType()),
    T.StructField("status_codes", T.MapType(T.StringType(), T.LongType())),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("requests_per_second", T.DoubleType()),
    T.StructField("events_per_second", T.DoubleType()),
    T.StructField("latency_ms", LATENCY),
    T.StructField("workers", T.MapType(T.StringType(), WORKER_STATS)),
])
