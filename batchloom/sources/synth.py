"""Deterministic synthetic batches for load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.display import batch_label


def check_options(size: int, invalid_rate: float) -> None:
    if size <= 0:
        raise ValueError("batch size must be positive")
    if not 0 <= invalid_rate <= 1:
        raise ValueError("invalid rate must be between 0 and 1")


def batch_numbers(spark: SparkSession, batches: int) -> DataFrame:
    """Numbers 1 to ``batches`` as column ``id``."""
    if batches <= 0:
        raise ValueError("number of batches must be positive")
    return spark.range(1, batches + 1)


def synth_batches(numbers: DataFrame, size: int, invalid_rate: float, now_ms: Column | int) -> DataFrame:
    """One batch per row of ``numbers.id``, with ``size`` events each.

    Event ``i`` of batch ``id`` loses its name and project when ``((id + i) % 1000) / 1000`` is below the
    rate. The clock is a parameter, so the same input gives the same batches.
    """
    check_options(size, invalid_rate)
    now = F.lit(now_ms).cast("bigint") if isinstance(now_ms, int) else now_ms

    def event(i: Column) -> Column:
        broken = F.lit(invalid_rate > 0) & ((F.col("id") + i) % 1000 / F.lit(1000.0) < F.lit(float(invalid_rate)))
        return F.struct(
            F.when(broken, "").otherwise("stress_event").alias("event"),
            now.alias("timestamp"),
            F.when(broken, "").otherwise("stress_project").alias("projectid"),
            F.lit("stress_org").alias("orgid"),
            F.lit("stress_funnel").alias("funnelid"),
            F.struct(i.alias("sequence")).alias("properties"),
        )

    return numbers.select(
        "id",
        batch_label(now, F.col("id")).alias("batch_id"),
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), event).alias("events"),
    )


def synth_messages(batches: DataFrame) -> DataFrame:
    """The batches as message envelopes, ordered by their number."""
    return batches.select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("message_id"),
        F.col("id").alias("message_order"),
        "batch_id",
        F.to_json(F.struct("batch_id", "events")).alias("payload"),
    )
