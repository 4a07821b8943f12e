"""Leases of delivered messages: who holds a message until when, and from when on another consumer may claim it.

A delivery log has a row per delivery and per acknowledgement of a message. A delivery gives its consumer a lease. It
ends with the first acknowledgement of the message, by whomever, or with the next delivery. A message whose lease has
lasted ``IDLE_MS`` without either may be claimed by any consumer; a claim is the next delivery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A message that was not acknowledged for so long may be claimed.
IDLE_MS = 60_000
#: A message's log is cut into pieces of this length, so that one message with very many rows is not one task's work.
SLICE_MS = 3_600_000
DELIVERED, ACKNOWLEDGED = "delivered", "acknowledged"


def _times(kind: str) -> Column:
    return F.when(F.col("kind") == kind, F.col("at_ms"))


def lease_timeline(log: DataFrame, idle_ms: int = IDLE_MS, slice_ms: int = SLICE_MS) -> DataFrame:
    """One row per delivery of ``log (message_id, consumer, kind, at_ms)``.

    Adds ``ended_ms`` and ``ended_by`` (``acknowledged``, ``claimed``, or null while the lease lasts), ``claimable_ms``
    (when it could be claimed, null if it ended before) and ``early`` (delivered again before that time).

    Ties: of rows with equal times deliveries come first, by consumer, nulls last; an acknowledgement at the time of a delivery
    therefore ends it, and a lease that is acknowledged and claimed at the same time was acknowledged. Equal deliveries
    follow one another. Acknowledgements without a delivery before them end nothing, a second one neither, and a delivery
    after an acknowledgement begins a new lease. Rows of other kinds, without a message or without a time are left out.
    """
    rows = log.filter(F.col("kind").isin(DELIVERED, ACKNOWLEDGED) & F.col("message_id").isNotNull() & F.col("at_ms").isNotNull())
    rows = rows.select("message_id", "consumer", "kind", "at_ms", F.floor(F.col("at_ms") / slice_ms).alias("slice"))
    # What comes first in each slice, and from that what comes first after it: a few rows per message.
    firsts = rows.groupBy("message_id", "slice").agg(
        F.min(_times(DELIVERED)).alias("delivered"), F.min(_times(ACKNOWLEDGED)).alias("acked")
    )
    later = Window.partitionBy("message_id").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select(
        "message_id", "slice", F.min("delivered").over(later).alias("next_delivered"),
        F.min("acked").over(later).alias("next_acked"),
    )
    order = [F.col("at_ms"), (F.col("kind") == ACKNOWLEDGED), F.col("consumer").asc_nulls_last()]
    after = Window.partitionBy("message_id", "slice").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    inside = rows.withColumns({
        "delivered": F.min(_times(DELIVERED)).over(after), "acked": F.min(_times(ACKNOWLEDGED)).over(after),
    }).filter(F.col("kind") == DELIVERED)
    joined = inside.join(firsts, ["message_id", "slice"])
    delivered, acked = F.coalesce("delivered", "next_delivered"), F.coalesce("acked", "next_acked")
    by_ack = acked.isNotNull() & (delivered.isNull() | (acked <= delivered))
    claimable = F.col("at_ms") + idle_ms
    return joined.withColumns({"_ended": F.least(delivered, acked), "_delivered": delivered, "_by_ack": by_ack}).select(
        "message_id", "consumer", F.col("at_ms").alias("delivered_ms"),
        F.col("_ended").alias("ended_ms"),
        F.when(F.col("_by_ack"), ACKNOWLEDGED).when(F.col("_delivered").isNotNull(), "claimed").alias("ended_by"),
        F.when(F.coalesce(F.col("_ended") >= claimable, F.lit(True)), claimable).alias("claimable_ms"),
        F.coalesce(~F.col("_by_ack") & (F.col("_delivered") < claimable), F.lit(False)).alias("early"),
    )


def claimable_at(timeline: DataFrame, at_ms: int) -> DataFrame:
    """Leases that any consumer could claim at a time: the minute was over, and they had not ended."""
    open_then = F.col("ended_ms").isNull() | (F.col("ended_ms") > at_ms)
    return timeline.filter((F.col("claimable_ms") <= at_ms) & open_then)
