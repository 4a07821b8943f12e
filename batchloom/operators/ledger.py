"""The idempotency ledger: which batch contents are new, delivered again, or in conflict.

The first writer of a batch id owns it for ever. A stored ledger row wins over everything that comes later;
without one the smallest ``message_order`` among the accepted deliveries wins. Only accepted batches compete.

Hot batch ids: deliveries are first reduced to distinct contents (partial aggregation before the shuffle). The
joins that decide are one to one, on ``batch_id`` between owners and ledger rows and on
``(batch_id, payload_hash)`` between contents and owners, so they never bring all deliveries, or all contents,
of one id together. Only tagging every delivery is many to one; see ``lookup_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.functions.canonical import event_digests
from batchloom.operators.bloom import anti_join
from batchloom.operators.layout import bucket
from batchloom.operators.spread import fits_broadcast, lookup_join

CONTENT = ["batch_id", "payload_hash"]


def batch_contents(accepted: DataFrame, row_id: str = "message_id") -> DataFrame:
    """One row per distinct content of a batch id, with its first delivery.

    ``row_id`` must be unique, so that exactly one delivery is the first.
    """
    # A message without an order comes after all that have one.
    first = F.struct(F.col("message_order").isNull().alias("unordered"), "message_order", F.col(row_id).alias("row_id"))
    # Accepted batches have an id. Saying so gives both uses of the contents the same plan, so one shuffle
    # serves both.
    named = accepted.filter("batch_id IS NOT NULL")
    return named.groupBy(*CONTENT).agg(F.min(first).alias("first"))


def judge_contents(contents: DataFrame, ledger: DataFrame, buckets: int) -> DataFrame:
    """Add ``verdict`` to each content: ``new``, ``duplicate`` or ``conflict``.

    Of a new content only the first delivery is new; the others are duplicates. The ledger is joined where it lies in
    its ``buckets``: only one row per batch id moves, after the contents of each id were put together.
    """
    firsts = contents.groupBy("batch_id").agg(F.min_by("payload_hash", "first").alias("first_hash"))
    stored = ledger.select("batch_id", F.col("payload_hash").alias("stored_hash"))
    # Dealt as the ledger is: with more partitions on this side Spark would move the ledger instead.
    owners = firsts.repartition(buckets, "batch_id").join(stored.hint("merge"), "batch_id", "left").select(
        "batch_id",
        F.coalesce("stored_hash", "first_hash").alias("payload_hash"),
        F.when(F.col("stored_hash").isNull(), "new").otherwise("duplicate").alias("owner_verdict"),
    )
    return contents.join(owners, CONTENT, "left").select(
        *CONTENT, "first", F.coalesce("owner_verdict", F.lit("conflict")).alias("verdict")
    )


def content_parts(buckets: int) -> Column:
    """Aggregate over contents: the buckets of their ids, ``buckets`` at most."""
    return F.collect_set(bucket(F.col("batch_id"), buckets))


def relevant_ledger(ledger: DataFrame, parts: list[int]) -> DataFrame:
    """The ledger rows that contents with these ``content_parts`` can meet, by folder."""
    return ledger.filter(F.col("part").isin(parts))


def tag_deliveries(
    accepted: DataFrame, verdicts: DataFrame, row_id: str = "message_id", small: bool | None = None
) -> DataFrame:
    """Status of every accepted delivery: ``new`` for a new content's first, else ``duplicate`` or ``conflict``.

    ``small`` says whether the verdicts fit a broadcast, where that is known.
    """
    joined = lookup_join(accepted, verdicts, CONTENT, F.col(row_id), small=small)
    status = F.when(
        (F.col("verdict") == "new") & (F.col(row_id) != F.col("first.row_id")), F.lit("duplicate")
    ).otherwise(F.col("verdict"))
    return joined.withColumn("status", status).drop("first", "verdict")


def new_batches(verdicts: DataFrame) -> DataFrame:
    """Ledger rows to add: insert-if-absent on ``batch_id``."""
    return verdicts.filter("verdict = 'new'").select(*CONTENT)


def owner_digests(events: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """``(batch_id, owner)``: digests of the stored events of some batches in order, one row per batch.

    ``batch_ids`` holds each id once. Only their events are read further, by a broadcast of the ids where they are few.
    """
    kept = events.join(F.broadcast(batch_ids) if fits_broadcast(batch_ids) else batch_ids, "batch_id", "left_semi")
    one = F.array(F.struct(*[f.name for f in S.EVENT.fields]))
    digests = kept.withColumn("_one", one).select("batch_id", "event_index", event_digests("_one")[0].alias("digest"))
    rows = digests.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("event_index", "digest"))).alias("rows"))
    return rows.select("batch_id", F.transform("rows", lambda r: r["digest"]).alias("owner"))


def conflict_places(conflicts: DataFrame, owners: DataFrame, spread_by: str = "message_id") -> DataFrame:
    """Add ``places``: the places among the valid events at which a message in conflict differs from the stored batch.

    ``conflicts`` holds validated messages with their ``valid_list``. A place that only one side has is a difference; a
    batch without an owner in ``owners`` (a written table) gives all its places. Many messages may be in conflict with
    one batch: see ``lookup_join``.
    """
    judged = conflicts.withColumn("_digests", event_digests("valid_list"))
    joined = lookup_join(judged, owners, ["batch_id"], F.col(spread_by), how="left")
    last = F.greatest(F.size("_digests"), F.coalesce(F.size("owner"), F.lit(0))) - 1
    differs = lambda i: ~F.try_element_at("_digests", i + 1).eqNullSafe(F.try_element_at("owner", i + 1))
    places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), differs)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("places", places).drop("_digests", "owner")


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-if-absent on ``(batch_id, event_index)``; only events that may be stored already are shuffled."""
    return anti_join(events, stored, ["batch_id", "event_index"])


def orphan_events(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose batch is not in the ledger; must be empty.

    Nearly all batches are in the ledger, so their ids are put together before they meet it, and only ids that are not
    in it are sought among the events.
    """
    ids = events.select("batch_id").distinct()
    lost = ids.join(ledger.select("batch_id").hint("merge"), "batch_id", "left_anti")
    lost = lost.select(F.col("batch_id").alias("_lost"))
    return events.join(lost, F.col("batch_id").eqNullSafe(F.col("_lost")), "left_semi")


def pending_messages(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages delivered but not acknowledged."""
    return messages.join(processed.select("message_id"), "message_id", "left_anti")
