"""JSON text to typed batches and events. Narrow: no shuffle, no Python per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.functions import fields as J
from batchloom.operators.once import computed_once
from batchloom.operators.validate import event_error

_EVENT_ARRAY = f"array<{S.EVENT.simpleString()}>"


def decode_batches(messages: DataFrame, text: str = "payload", strict: bool = False) -> DataFrame:
    """Add ``batch_id``, ``events`` and ``decode_error`` to rows holding a batch as JSON text.

    One wrongly typed field in any event fails the whole batch: its ``decode_error`` is set and ``events``
    is NULL. A ``null`` element is an event without values, which validation turns away later. A number beyond the
    range of 64-bit floats fails the batch too. With ``strict`` the text must be one JSON value and nothing more;
    else bytes after it are ignored. Either way the text is parsed once.
    """
    element_fields = f"""
        transform({J.as_array("_raw_events")}, e ->
            CASE WHEN is_variant_null(e) THEN CAST(map() AS {J.OBJECT}) ELSE {J.fold_keys(J.as_object("e"))} END)
    """
    picked = f"transform(_elements, e -> CASE WHEN e IS NOT NULL THEN {J.pick_event_fields('e')} END)"
    failed = f"""
        CASE WHEN _fields IS NULL THEN NOT {J.is_one_null("_values", text) if strict else J.is_null_text(text)}
             WHEN {J.has_infinite_number(text)} THEN true
             WHEN {J.wrong_type("_raw_id", "text")} THEN true
             WHEN {J.has_value("_raw_events")} AND _elements IS NULL THEN true
             ELSE coalesce(exists(_elements, e -> e IS NULL OR {J.event_has_wrong_type("e")}), false) END
    """
    events = f"coalesce(transform(_elements, e -> {J.typed_event('e')}), CAST(array() AS {_EVENT_ARRAY}))"
    parsed = messages
    if strict:
        parsed = messages.withColumn("_values", F.expr(J.marked_values(text)))
    decoded = (
        parsed.withColumn("_fields", F.expr(J.one_object("_values", text) if strict else J.json_fields(text)))
        .withColumns({
            "_raw_id": F.expr("try_element_at(_fields, 'batch_id')"),
            "_raw_events": F.expr("try_element_at(_fields, 'events')"),
        })
        .withColumn("_plain", F.expr(f"CASE WHEN NOT {J.may_need_folding(text)} THEN {J.plain_events('_raw_events')} END"))
        .withColumn("_elements", F.expr(f"CASE WHEN _plain IS NULL THEN {element_fields} END"))
        .withColumn("_elements", F.expr(f"coalesce(_plain, {picked})"))
        .withColumn("_error", F.expr(f"CASE WHEN {failed} THEN '{S.INVALID_JSON}' END"))
    )
    columns = {
        "batch_id": F.expr(f"CASE WHEN _error IS NULL THEN {J.typed_field('_raw_id', 'text')} END"),
        "events": F.expr(f"CASE WHEN _error IS NULL THEN {events} END"),
        "decode_error": F.col("_error"),
    }
    return computed_once(decoded, columns, [c for c in messages.columns if c not in columns])


def decode_events(bodies: DataFrame, text: str = "body") -> DataFrame:
    """Single-event path: add the typed ``event``, ``accepted`` and ``reason``. Accepted events are not stored.

    Bytes after the first JSON value are ignored; a number in it beyond the range of 64-bit floats is refused.
    """
    failed = f"""
        CASE WHEN _fields IS NULL THEN NOT {J.is_null_text(text)}
             WHEN {J.has_infinite_number(text)} THEN true
             ELSE {J.event_has_wrong_type('_raw')} END
    """
    decoded = (
        bodies.withColumn("_fields", F.expr(J.json_fields(text)))
        .withColumn("_raw", F.expr(J.pick_event_fields("_fields")))
        .withColumn("_failed", F.expr(failed))
    )
    event = {"event": F.expr(f"CASE WHEN NOT _failed THEN {J.typed_event('_raw')} END"), "failed": F.col("_failed")}
    return (
        computed_once(decoded, event, bodies.columns)
        .withColumn("reason", F.when(F.col("failed"), S.INVALID_JSON).otherwise(event_error(F.col("event"))))
        .withColumn("accepted", F.col("reason").isNull())
        .drop("failed")
    )
