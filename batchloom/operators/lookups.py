"""Queries over the stored events and the ledger.

Filters are plain column predicates, so they reach the Parquet scan. Each lookup adds those of the layout: a time range
names the folders of its days, and a project, organization or user the cells of the curve, by which row groups are
skipped. ``events`` is the store's table with its ``event_day`` and ``cell``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.contains import json_contains
from batchloom.operators.layout import bucket, in_cells, in_days

_TIME_ORDER = ["timestamp_ms", "batch_id", "event_index"]


def _between(start_ms: int | None, end_ms: int | None) -> Column:
    """Both ends belong to the range, ``None`` leaves one open."""
    time, found = F.col("timestamp_ms"), in_days(start_ms, end_ms)
    if start_ms is not None:
        found = found & (time >= start_ms)
    return found if end_ms is None else found & (time <= end_ms)


def events_by_project_name(events: DataFrame, project_id: str, name: str) -> DataFrame:
    own = (F.col("project_id") == project_id) & (F.col("name") == name)
    return events.filter(own & in_cells(project_id=project_id))


def events_by_project_time(events: DataFrame, project_id: str, name: str, start_ms: int, end_ms: int) -> DataFrame:
    return events_by_project_name(events, project_id, name).filter(_between(start_ms, end_ms))


def funnel_timeline(
    events: DataFrame, funnel_id: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """One funnel's events in time order; ties by batch and place."""
    return events.filter((F.col("funnel_id") == funnel_id) & _between(start_ms, end_ms)).orderBy(*_TIME_ORDER)


def events_by_properties(events: DataFrame, pattern: dict) -> DataFrame:
    return events.filter(json_contains(F.col("properties"), pattern))


def events_by_org_time(events: DataFrame, org_id: str, start_ms: int, end_ms: int) -> DataFrame:
    return events.filter((F.col("org_id") == org_id) & in_cells(org_id=org_id) & _between(start_ms, end_ms))


def events_by_user_time(
    events: DataFrame, user_id: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """One user's events in time order; events without a user never match."""
    own = (F.col("user_id") == user_id) & in_cells(user_id=user_id)
    return events.filter(own & _between(start_ms, end_ms)).orderBy(*_TIME_ORDER)


def batch_by_id(ledger: DataFrame, batch_id: str, buckets: int) -> DataFrame:
    """A batch's ledger row; one of the ``buckets`` is read."""
    own = (F.col("batch_id") == batch_id) & (F.col("part") == bucket(F.lit(batch_id), buckets))
    return ledger.filter(own).select("batch_id", "payload_hash")


def events_by_batch(events: DataFrame) -> DataFrame:
    """What the event store shows of a batch's events; ``EventStore.read_batch`` finds them."""
    return events.select(
        "batch_id", "event_index", "name", "project_id", "org_id", "funnel_id", "properties"
    )


_DAILY = ["project_id", "name", "event_day"]


def daily_counts(events: DataFrame) -> DataFrame:
    """Events, and their first and last time, per project, name and day; see ``layout`` for days out of range."""
    return events.groupBy(*_DAILY).agg(
        F.count("*").alias("events"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms")
    )


def merged_counts(counts: DataFrame) -> DataFrame:
    """``daily_counts`` of several sets of events that have none in common, put together."""
    return counts.groupBy(*_DAILY).agg(
        F.sum("events").alias("events"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")
    )


def stored_counts(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Number of ledger rows and of events per batch id, for ids in either table."""
    rows = ledger.select("batch_id", F.lit(1).alias("b"), F.lit(0).alias("e")).unionByName(
        events.select("batch_id", F.lit(0).alias("b"), F.lit(1).alias("e"))
    )
    return rows.groupBy("batch_id").agg(F.sum("b").alias("batches"), F.sum("e").alias("events"))
