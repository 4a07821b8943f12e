"""Ingest: messages in, events and ledger out, exactly once.

Delivery is at least once and the sink is idempotent. One epoch:

1. decode, validate and hash every message in one narrow pass, written to ``staging`` with a row number;
2. decide per distinct content against the ledger, tag every delivery;
3. write outcomes, events, quarantine and ledger rows of the epoch, then the stream's marker.

A bad message is put in quarantine with its reason and the stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from batchloom import schemas as S
from batchloom.operators import ledger as L
from batchloom.operators.decode import decode_batches
from batchloom.operators.spread import BROADCAST_ROWS, is_small, lookup_join, size_columns
from batchloom.operators.validate import enforce_batch_limit, stored_rows, validate_batches, with_payload_hash
from batchloom.sources.messages import envelope_error
from batchloom.sources.store import EventStore, Snapshot


def prepare(messages: DataFrame, max_events: int = 0) -> DataFrame:
    """Decode, admit, validate and hash messages; one output row per message, nothing is dropped."""
    error = envelope_error(F.col("batch_id"), F.col("payload"))
    if "line_error" in messages.columns:
        error = F.coalesce("line_error", error)
    envelopes = messages.withColumn("envelope_error", error).drop("line_error")
    admitted = enforce_batch_limit(decode_batches(envelopes, strict=True), max_events)
    validated = validate_batches(admitted)
    rejected = validated.withColumn("reason", F.coalesce("envelope_error", "admission_error", "reason"))
    return with_payload_hash(rejected).drop("envelope_error", "admission_error", "decode_error")


def _stage(store: EventStore, spark: SparkSession, messages: DataFrame, max_events: int) -> DataFrame:
    """Write the prepared messages once; from here on every step reads the written copy.

    Row numbers are fixed by the write, so later steps agree on them even when executors are lost. The text
    of accepted messages, most of the bytes, is not kept: their decoded events are.
    """
    prepared = prepare(messages, max_events).select(
        F.monotonically_increasing_id().alias("row_id"),
        "message_id", "message_order", "batch_id", "payload_hash", "reason",
        F.when(F.col("reason").isNotNull(), F.col("payload")).alias("payload"),
        "valid_list", "total_events", "valid_events", "invalid_events",
    )
    prepared.write.mode("overwrite").parquet(store.work_path("staging"))
    return spark.read.schema(prepared.schema).parquet(store.work_path("staging"))


def _fresh(staged: DataFrame, tagged: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Staged rows of the new messages.

    Events move only when both the new and the other messages are many: a small set of rows is broadcast by
    number, either the new rows or all the others.
    """
    is_new = F.col("status") == "new"
    new, others = tagged.filter(is_new).select("row_id"), tagged.filter(~is_new).select("row_id")
    if counts["new"] <= BROADCAST_ROWS:
        return staged.join(F.broadcast(new), "row_id", "left_semi")
    if sum(counts.values()) - counts["new"] <= BROADCAST_ROWS:
        return staged.join(F.broadcast(others), "row_id", "left_anti")
    return staged.join(new, "row_id", "left_semi")


def _conflicts(messages: DataFrame, tagged: DataFrame, max_events: int) -> DataFrame:
    """The messages in conflict, with their text, read once more from the source.

    Candidates are found by message id; decoding them again tells apart different contents sent under one id.
    """
    contents = tagged.filter(F.col("status") == "conflict").select("message_id", "payload_hash").distinct()
    ids = contents.select("message_id").distinct()
    # Numbered as read, before any shuffle, so that a repeated task spreads its rows as the first one did.
    place = F.col("place")
    numbered = messages.withColumn("place", F.monotonically_increasing_id())
    candidates = prepare(lookup_join(numbered, ids, ["message_id"], place), max_events)
    found = lookup_join(candidates, contents, ["message_id", "payload_hash"], place)
    return found.withColumn("reason", F.lit(S.CONFLICT))


def process_epoch(store: EventStore, messages: DataFrame, epoch: int, max_events: int = 0) -> None:
    """Ingest one micro-batch. Does nothing when the epoch is already committed.

    A store has one writer at a time; a try that breaks off is replaced by the next one.
    """
    spark = messages.sparkSession
    snapshot = store.snapshot(spark)
    if store.is_committed(snapshot, epoch):
        return
    messages = messages.withColumn("message_id", F.coalesce("message_id", F.lit("")))
    staged = _stage(store, spark, messages, max_events)
    _decide(store, messages, staged, epoch, max_events, snapshot)
    store.commit(spark, epoch, snapshot)


def _observed(rows: DataFrame, write, *counts: Column) -> dict:
    """Write ``rows`` and count on the way, instead of reading what was written."""
    if not counts:
        write(rows)
        return {}
    seen = Observation()
    write(rows.observe(seen, *counts))
    return seen.get


def _decide(
    store: EventStore, messages: DataFrame, staged: DataFrame, epoch: int, max_events: int, snapshot: Snapshot
) -> None:
    """Write everything an epoch adds to the store as it is in ``snapshot``."""
    spark = messages.sparkSession
    created_at = F.lit(datetime.now(timezone.utc)).cast("timestamp")
    accepted = staged.filter("reason IS NULL")
    rejected = staged.filter("reason IS NOT NULL")
    buckets = store.buckets(spark)

    def work(step: str, rows: DataFrame, *counts: Column) -> tuple[DataFrame, dict]:
        path = store.work_path(step)
        seen = _observed(rows, lambda r: r.write.mode("overwrite").parquet(path), *counts)
        return spark.read.schema(rows.schema).parquet(path), seen

    found = L.batch_contents(accepted, "row_id")
    contents, size = work("contents", found, *size_columns(found), L.content_parts(buckets).alias("parts"))
    known = L.relevant_ledger(store.read(spark, "batches", snapshot), size["parts"])
    verdicts, _ = work("verdicts", L.judge_contents(contents, known, buckets))

    tagged = L.tag_deliveries(accepted.drop("valid_list", "payload"), verdicts, "row_id", is_small(size))
    turned_away = rejected.withColumn("status", F.lit("rejected"))
    thin = S.OUTCOMES.fieldNames()
    outcomes = tagged.select(*thin).unionByName(turned_away.select(*thin))
    kinds = [F.count_if(F.col("status") == status).alias(status) for status in ("new", "duplicate", "conflict", "rejected")]
    counts = _observed(outcomes, lambda rows: store.write("outcomes", epoch, rows), *kinds)
    tagged = store.written(spark, "outcomes", epoch)

    fresh = stored_rows(_fresh(staged, tagged, counts))
    store.write("events", epoch, fresh.withColumn("created_at", created_at))
    quarantined = rejected.select(*S.QUARANTINE.fieldNames())
    if counts["conflict"]:
        conflicts = _conflicts(messages, tagged, max_events)
        quarantined = quarantined.unionByName(conflicts.select(*S.QUARANTINE.fieldNames()))
    store.write("quarantine", epoch, quarantined)
    store.write("batches", epoch, L.new_batches(verdicts).withColumn("created_at", created_at))


def epoch_writer(store: EventStore, max_events: int = 0) -> Callable[[DataFrame, int], None]:
    """The stream's sink; the stream's id, kept in its checkpoint, names its epochs."""

    def write(messages: DataFrame, epoch: int) -> None:
        query_id = messages.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        process_epoch(replace(store, stream=query_id), messages, epoch, max_events)

    return write


def ingest_stream(
    store: EventStore, messages: DataFrame, checkpoint: str, max_events: int = 0, **trigger
) -> StreamingQuery:
    """Start the stream; a message counts as acknowledged once its epoch is in the stream's checkpoint."""
    store.create(messages.sparkSession)
    return (
        messages.writeStream.foreachBatch(epoch_writer(store, max_events))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def drain(
    store: EventStore, messages: DataFrame, checkpoint: str, max_events: int = 0, timeout: int | None = None
) -> bool:
    """Process all that is there, then stop; False when ``timeout`` seconds ran out first."""
    query = ingest_stream(store, messages, checkpoint, max_events, availableNow=True)
    done = query.awaitTermination(timeout)
    if done is False:
        query.stop()
        return False
    return True


def live_lag(query: StreamingQuery) -> dict[str, int]:
    """Messages of the last epoch, and files and bytes that wait behind it; zeros before the first epoch."""
    progress = query.lastProgress
    if progress is None:
        return {"messages": 0, "files": 0, "bytes": 0}
    waiting = [source.metrics or {} for source in progress.sources]

    def total(metric: str) -> int:
        return sum(int(metrics.get(metric, 0)) for metrics in waiting)

    return {
        "messages": progress.numInputRows, "files": total("numFilesOutstanding"), "bytes": total("numBytesOutstanding"),
    }


def quarantined_conflicts(store: EventStore, spark: SparkSession) -> DataFrame:
    """Messages in conflict with the places at which they differ from the stored batch: ``(message_id, batch_id, places)``.

    Their texts are kept in quarantine and decoded again; only the events of their batches are read.
    """
    snapshot = store.snapshot(spark)
    kept = store.read(spark, "quarantine", snapshot).filter(F.col("reason") == S.CONFLICT)
    decoded = validate_batches(decode_batches(kept.drop("reason"), strict=True)).select("message_id", "batch_id", "valid_list")
    owners = L.owner_digests(store.read(spark, "events", snapshot), kept.select("batch_id").distinct())
    path = store.work_path("owners")
    owners.write.mode("overwrite").parquet(path)
    found = L.conflict_places(decoded, spark.read.schema(owners.schema).parquet(path))
    return found.select("message_id", "batch_id", "places")


def append_batches(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The plain backend: append every accepted batch as it is, nested, without looking for duplicates."""
    accepted = prepare(messages).filter("reason IS NULL")
    return (
        accepted.select("batch_id", F.col("valid_list").alias("events"))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
