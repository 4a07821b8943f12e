"""Event and batch validation on decoded batches. Narrow: everything stays inside the batch's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.functions.canonical import canonical_batch_json, payload_hash
from batchloom.operators.once import computed_once


def event_error(event: Column) -> Column:
    """The first failing check of an event, NULL when it is valid. Blank text is not empty text."""
    return (
        F.when(event["name"] == "", S.NAME_REQUIRED)
        .when(event["timestamp_ms"] <= 0, S.TIMESTAMP_REQUIRED)
        .when(event["project_id"] == "", S.PROJECT_REQUIRED)
        .when(event["org_id"] == "", S.ORGANIZATION_REQUIRED)
    )


def batch_error(batch_id: Column, total: Column, valid: Column) -> Column:
    return (
        F.when(batch_id == "", S.MISSING_BATCH_ID)
        .when(total == 0, S.EMPTY_BATCH)
        .when(valid == 0, S.NO_VALID_EVENTS)
    )


def enforce_batch_limit(decoded: DataFrame, max_events: int) -> DataFrame:
    """Admission check before any validation, on the raw number of events; 0 or less means no limit.

    Adds ``admission_error``. Batches that are empty or have no id pass.
    """
    over = F.lit(False) if max_events <= 0 else F.size("events") > max_events
    return decoded.withColumn(
        "admission_error", F.coalesce("decode_error", F.when(over, F.lit(S.OVER_LIMIT)))
    )


def validate_batches(decoded: DataFrame) -> DataFrame:
    """Add the surviving events in order, the three counts and the batch's ``reason`` (NULL = accepted).

    Batches without an id or without events report 0 valid and 0 invalid events, whatever they hold.
    """
    decodes, checked = F.col("decode_error").isNull(), F.col("batch_id") != ""
    survivors = F.filter("events", lambda e: event_error(e).isNull())
    total, valid = F.size("events"), F.size("_survivors")
    columns = {
        "valid_list": F.col("_survivors"),
        "total_events": F.when(decodes, total),
        "valid_events": F.when(checked, valid).otherwise(0),
        "invalid_events": F.when(checked, total - valid).otherwise(0),
        "reason": F.coalesce("decode_error", batch_error(F.col("batch_id"), total, valid)),
    }
    return computed_once(decoded.withColumn("_survivors", F.when(checked, survivors)), columns, decoded.columns)


def with_payload_hash(validated: DataFrame) -> DataFrame:
    """Add the hash of the surviving contents of accepted batches."""
    text = canonical_batch_json("batch_id", "valid_list")
    return validated.withColumn("payload_hash", F.when(F.col("reason").isNull(), payload_hash(text)))


def batch_results(validated: DataFrame, *keys: str) -> DataFrame:
    """Counts and outcome per message."""
    return validated.select(*keys, "batch_id", "total_events", "valid_events", "invalid_events", "reason")


def flatten_events(batches: DataFrame, events: str = "events", *keys: str) -> DataFrame:
    """One row per event with its 0-based position; a batch without events yields nothing."""
    return batches.select(*keys, "batch_id", F.posexplode(events).alias("event_index", "event"))


def stored_rows(validated: DataFrame, *keys: str) -> DataFrame:
    """The events to store of accepted batches, numbered by their place among the survivors."""
    flat = flatten_events(validated.filter("reason IS NULL"), "valid_list", *keys)
    return flat.select(*keys, "batch_id", "event_index", "event.*")


def rejected_events(validated: DataFrame, *keys: str) -> DataFrame:
    """One row per invalid event with its place in the batch as sent.

    Only batches with an id and at least one event are looked at; one without any valid event still counts.
    """
    flat = flatten_events(validated.filter("batch_id <> ''"), "events", *keys)
    return flat.select(*keys, "batch_id", "event_index", event_error(F.col("event")).alias("error")).filter(
        "error IS NOT NULL"
    )
