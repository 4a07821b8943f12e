from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.operators.decode import decode_batches
from batchloom.operators.validate import (
    enforce_batch_limit,
    event_error,
    flatten_events,
    rejected_events,
    stored_rows,
    validate_batches,
)
from helpers import batch, event, messages


def _decoded(spark, *payloads):
    return decode_batches(messages(spark, payloads))


def test_first_failing_check_wins(spark):
    cases = [
        (event(event="", timestamp=0, projectid="", orgid=""), S.NAME_REQUIRED),
        (event(timestamp=0, projectid="", orgid=""), S.TIMESTAMP_REQUIRED),
        (event(timestamp=-1), S.TIMESTAMP_REQUIRED),
        (event(projectid=..., orgid=""), S.PROJECT_REQUIRED),
        (event(orgid=""), S.ORGANIZATION_REQUIRED),
        (event(event=" "), None),
    ]
    flat = flatten_events(_decoded(spark, batch("b", *[c[0] for c in cases])))
    rows = flat.orderBy("event_index").select(event_error(F.col("event")).alias("error")).collect()
    assert [r.error for r in rows] == [c[1] for c in cases]


def test_survivors_are_renumbered_and_rejects_keep_their_place(spark):
    bad, good = event(event=""), event()
    validated = validate_batches(_decoded(spark, batch("b", bad, good, bad, good)))
    assert sorted(r.event_index for r in stored_rows(validated).collect()) == [0, 1]
    assert sorted(r.event_index for r in rejected_events(validated).collect()) == [0, 2]


def test_batch_reasons(spark):
    bad = event(event="")
    payloads = [batch("", ), batch("", event(), event()), batch("b"), batch("b", bad, bad), batch("b", bad, event())]
    rows = validate_batches(_decoded(spark, *payloads)).orderBy("message_order").collect()
    assert [(r.reason, r.total_events, r.valid_events, r.invalid_events) for r in rows] == [
        (S.MISSING_BATCH_ID, 0, 0, 0),
        (S.MISSING_BATCH_ID, 2, 0, 0),
        (S.EMPTY_BATCH, 0, 0, 0),
        (S.NO_VALID_EVENTS, 2, 0, 2),
        (None, 2, 1, 1),
    ]
    rejected = rejected_events(validate_batches(_decoded(spark, *payloads)), "message_id")
    assert sorted((r.message_id, r.event_index) for r in rejected.collect()) == [("m3", 0), ("m3", 1), ("m4", 0)]


def test_batch_limit(spark):
    decoded = _decoded(spark, batch("b", *[event()] * 100), batch("b", *[event()] * 101), batch(""), "{")

    def errors(limit):
        rows = enforce_batch_limit(decoded, limit).orderBy("message_order").collect()
        return [r.admission_error for r in rows]

    assert errors(100) == [None, S.OVER_LIMIT, None, S.INVALID_JSON]
    assert errors(0) == [None, None, None, S.INVALID_JSON]
    assert errors(-1) == [None, None, None, S.INVALID_JSON]
