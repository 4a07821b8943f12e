"""Batch messages: ``(message_id, message_order, batch_id, payload)`` as a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.functions.canonical import canonical_batch_json
from batchloom.functions.fields import OBJECT, STRICT_JSON


def envelope_error(batch_id: Column, payload: Column) -> Column:
    """A message needs both a batch id and a payload; processing then uses the payload's own id only."""
    return F.when(batch_id.isNull(), S.BAD_ENVELOPE_ID).when(payload.isNull(), S.BAD_ENVELOPE_PAYLOAD)


def message_lines(lines: DataFrame) -> DataFrame:
    """Messages and their ``line_error`` from lines ``value``, one JSON envelope each; blank lines are none.

    The batch id and the payload must be text. A line that is no JSON object, and a value of the wrong type, keep
    their text as ``payload``, so that nothing is lost on the way to quarantine.
    """
    def text(key: str) -> str:
        return f"CASE WHEN schema_of_variant(_e['{key}']) = 'STRING' THEN CAST(_e['{key}'] AS string) END"

    def wrong(key: str) -> str:
        return f"(_e['{key}'] IS NOT NULL AND NOT is_variant_null(_e['{key}']) AND {text(key)} IS NULL)"

    # ``to_json`` of a batch object of the wrong type is its text again, up to white space and key order.
    return (
        lines.filter("trim(value) != ''")
        .withColumn("_e", F.expr(f"from_json(value, '{OBJECT}', {STRICT_JSON})"))
        .select(
            F.expr(f"coalesce({text('message_id')}, to_json(_e['message_id']))").alias("message_id"),
            F.expr("try_variant_get(_e['message_order'], '$', 'bigint')").alias("message_order"),
            F.expr(text("batch_id")).alias("batch_id"),
            F.expr(
                f"CASE WHEN _e IS NULL THEN value WHEN {wrong('payload')} THEN to_json(_e['payload']) "
                f"ELSE {text('payload')} END"
            ).alias("payload"),
            F.expr(
                f"CASE WHEN _e IS NULL THEN '{S.BAD_ENVELOPE}' WHEN {wrong('batch_id')} THEN '{S.BAD_ENVELOPE_ID}' "
                f"WHEN {wrong('payload')} THEN '{S.BAD_ENVELOPE_PAYLOAD}' END"
            ).alias("line_error"),
        )
    )


def read_batch_messages(spark: SparkSession, path: str) -> DataFrame:
    return message_lines(spark.read.text(path))


def stream_batch_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages as they arrive in a folder; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return message_lines(reader.text(path))


def stream_id_order(message_id: Column) -> Column:
    """Numeric order of stream ids of the form ``<ms>-<sequence>``, which do not sort as text."""

    def part(n: int) -> Column:
        return F.split_part(message_id, F.lit("-"), F.lit(n)).try_cast("bigint")

    return F.struct(part(1).alias("ms"), part(2).alias("sequence"))


def with_stream_order(envelopes: DataFrame) -> DataFrame:
    """Messages from envelopes ``(message_id, batch_id, payload)`` whose ids carry the order."""
    return envelopes.withColumn("message_order", stream_id_order(F.col("message_id")))


def kafka_messages(raw: DataFrame) -> DataFrame:
    """Messages from a frame of the Kafka source: the record key is the batch id.

    Equal keys share a partition, so the offset orders the deliveries of a batch; record times may tie or be set by
    clients.
    """
    return raw.select(
        F.concat_ws("-", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("message_id"),
        F.col("offset").alias("message_order"),
        F.col("key").cast("string").alias("batch_id"),
        F.col("value").cast("string").alias("payload"),
    )


def publish(admitted: DataFrame) -> DataFrame:
    """Envelopes for decoded batches that passed admission: the batch's id next to its canonical text.

    The text holds all events as sent, valid or not; only consumers validate.
    """
    passed = admitted.filter("admission_error IS NULL")
    payload = canonical_batch_json("batch_id", "events").alias("payload")
    return passed.select("message_id", "message_order", "batch_id", payload)
