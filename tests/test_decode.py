"""Strict decoding: golden edge cases."""

import random

import pytest

from batchloom import schemas as S
from batchloom.functions import fields as J
from batchloom.operators.decode import decode_batches, decode_events
from batchloom.operators.validate import enforce_batch_limit, stored_rows, validate_batches
from batchloom.sources.messages import kafka_messages, publish
from helpers import batch, event, messages

GOOD = '{"event":"a","timestamp":1,"projectid":"p","orgid":"o"}'


def _with(field):
    return '{"batch_id":"b","events":[' + GOOD + "," + GOOD[:-1] + "," + field + "}]}"


# payload, decodes?, batch_id, number of events
CASES = [
    (_with('"timestamp":"5"'), False, None, None),
    (_with('"timestamp":1.5'), False, None, None),
    (_with('"timestamp":1.0'), False, None, None),
    (_with('"timestamp":1e3'), False, None, None),
    (_with('"timestamp":12345678901234567890'), False, None, None),
    (_with('"timestamp":9223372036854775807'), True, "b", 2),
    (_with('"event":5'), False, None, None),
    (_with('"user_id":{}'), False, None, None),
    (_with('"properties":[]'), False, None, None),
    (_with('"properties":"x"'), False, None, None),
    (_with('"context":5'), False, None, None),
    (_with('"received_at":true'), False, None, None),
    (_with('"properties":null'), True, "b", 2),
    (_with('"event":null'), True, "b", 2),
    (_with('"unknown":{"deep":[1,null]}'), True, "b", 2),
    (_with('"properties":{"a":1,"a":2}'), True, "b", 2),
    ('{"BATCH_ID":"b","Events":[' + GOOD.replace("event", "EVENT") + "]}", True, "b", 1),
    ('{"batch_id":"a","BATCH_ID":"b","events":[]}', True, "b", 0),
    ('{"BATCH_ID":"b","batch_id":"a","events":[]}', True, "a", 0),
    ('{"batch_id":"x"', False, None, None),
    ("", False, None, None),
    ("[]", False, None, None),
    ("5", False, None, None),
    ("null", True, "", 0),
    ("{}", True, "", 0),
    ('{"batch_id":null,"events":null}', True, "", 0),
    ('{"batch_id":5,"events":[]}', False, None, None),
    ('{"batch_id":"b","events":{}}', False, None, None),
    ('{"batch_id":"b","events":[5]}', False, None, None),
    ('{"batch_id":"b","events":[[]]}', False, None, None),
    ('{"batch_id":"b","events":[null,' + GOOD + "]}", True, "b", 2),
    ('{"batch_id":"b","events":[]} trailing', True, "b", 0),
    ("{'batch_id':'b'}", False, None, None),
    ('{"batch_id":"b","events":[{"properties":{"x":NaN}}]}', False, None, None),
]


def test_golden_batches(spark):
    decoded = decode_batches(messages(spark, [c[0] for c in CASES]))
    rows = decoded.orderBy("message_order").selectExpr("decode_error", "batch_id", "size(events) AS n").collect()
    for (text, decodes, batch_id, n), row in zip(CASES, rows, strict=True):
        assert row.decode_error == (None if decodes else S.INVALID_JSON), text
        if decodes:
            assert (row.batch_id, row.n) == (batch_id, n), text


STRICT_CASES = [
    (GOOD_BATCH := '{"batch_id":"b","events":[' + GOOD + "]}", "b"),
    (" \n" + GOOD_BATCH + "\t ", "b"),
    ("null", ""),
    (" null ", ""),
    (GOOD_BATCH + " x", None),
    (GOOD_BATCH + GOOD_BATCH, None),
    (GOOD_BATCH + "," + GOOD_BATCH, None),
    (GOOD_BATCH + "]", None),
    (GOOD_BATCH + ',{"":1}]', None),
    (GOOD_BATCH + ",null", None),
    ("null,null", None),
    ("null]", None),
    ("]", None),
    ("", None),
    ("   ", None),
    (",", None),
    ("5", None),
    ("[]", None),
    ('"x"', None),
    ("nul", None),
    (GOOD_BATCH[:-1], None),
    (GOOD_BATCH[:-1] + ',"":5}', "b"),
    (GOOD_BATCH + "//", None),
    (None, None),
]


def test_strict_batches(spark):
    """Kept messages are one JSON value and nothing more."""
    rows = decode_batches(messages(spark, [c[0] for c in STRICT_CASES]), strict=True).orderBy("message_order").collect()
    for (text, batch_id), row in zip(STRICT_CASES, rows, strict=True):
        assert row.batch_id == batch_id and (row.decode_error is None) == (batch_id is not None), text


def test_null_element_is_an_invalid_event(spark):
    payload = '{"batch_id":"b","events":[null,' + GOOD + "]}"
    validated = validate_batches(decode_batches(messages(spark, [payload])))
    row = validated.collect()[0]
    assert (row.total_events, row.valid_events, row.invalid_events, row.reason) == (2, 1, 1, None)
    assert [r.event_index for r in stored_rows(validated).collect()] == [0]


def test_defaults(spark):
    payload = batch("b", event(user_id="", properties={}), event())
    rows = (
        stored_rows(validate_batches(decode_batches(messages(spark, [payload]))))
        .selectExpr(
            "event_id", "funnel_id", "received_at_ms", "user_id", "session_id", "to_json(properties) AS properties",
            "is_variant_null(context) AS no_context",
        )
        .collect()
    )
    assert tuple(rows[0]) == ("", "", 0, "", None, "{}", True)
    assert tuple(rows[1]) == ("", "", 0, None, None, "null", True)


def test_exact_integers_are_kept(spark):
    payload = _with('"properties":{"n":9007199254740993}')
    row = decode_batches(messages(spark, [payload])).selectExpr("to_json(events[1].properties) AS p").collect()[0]
    assert row.p == '{"n":9007199254740993}'


@pytest.mark.parametrize("size", [300])
def test_wide_batches_keep_order(spark, size):
    payload = batch("b", *[event(timestamp=i + 1) for i in range(size)])
    row = decode_batches(messages(spark, [payload])).selectExpr("transform(events, e -> e.timestamp_ms) AS t").collect()[0]
    assert row.t == list(range(1, size + 1))


def _scrambled(rng, depth=0):
    """Random JSON over the known keys, in right and wrong letters and kinds, with escapes and repeated keys."""
    keys = ["id", "event", "timestamp", "projectid", "orgid", "user_id", "properties", "context", "batch_id", "events", "x"]
    pick = rng.random()
    if depth > 2 or pick < 0.55:
        return rng.choice(['"a"', '"Event"', "1", "1.5", "null", "true", '""', '"\\u0041"', "{}", "[]", "1e400", "-1E+999", '"1e400"'])
    if pick < 0.7:
        return "[" + ",".join(_scrambled(rng, depth + 1) for _ in range(rng.randrange(3))) + "]"
    fields = []
    for _ in range(rng.randrange(5)):
        key = rng.choice(keys)
        spelled = rng.choice([key] * 6 + [key.upper(), key.title(), key[:-1] + "\\u%04x" % ord(key[-1].upper())])
        fields.append(f'"{spelled}":{_scrambled(rng, depth + 1)}')
    return "{" + ",".join(fields) + "}"


def test_known_keys_as_they_are_or_folded(spark, monkeypatch):
    """Both ways to take the fields of events agree; folding everything is the slow one."""
    rng = random.Random(4)
    sent = []
    for _ in range(1_500):
        events = [_scrambled(rng) for _ in range(rng.randrange(4))]
        sent.append('{"batch_id":"b","%s":[%s]}' % (rng.choice(["events"] * 5 + ["Events"]), ",".join(events)))
    sent += [c[0] for c in CASES]
    shown = ["message_order", "decode_error", "batch_id", "to_json(events) AS events"]
    quick = decode_batches(messages(spark, sent)).selectExpr(*shown).orderBy("message_order").collect()
    monkeypatch.setattr(J, "may_need_folding", lambda text: f"({text} IS NOT NULL)")
    slow = decode_batches(messages(spark, sent)).selectExpr(*shown).orderBy("message_order").collect()
    assert quick == slow
    assert sum(r.decode_error is None for r in quick) > 200


def test_single_events(spark):
    cases = [
        (GOOD, True, None),
        (GOOD.replace('"event"', '"EVENT"'), True, None),
        ("null", False, S.NAME_REQUIRED),
        ("", False, S.INVALID_JSON),
        (GOOD.replace("1", "-1"), False, S.TIMESTAMP_REQUIRED),
        (GOOD.replace('"o"', '""'), False, S.ORGANIZATION_REQUIRED),
        (GOOD.replace('"p"', "7"), False, S.INVALID_JSON),
        (GOOD[:-1] + ',"properties":{"x":1e400}}', False, S.INVALID_JSON),
        (GOOD[:-1] + ',"unknown":[-1e999]}', False, S.INVALID_JSON),
        (GOOD[:-1] + ',"properties":{"x":"1e400","y":1e300}}', True, None),
        (GOOD + " trailing", True, None),
    ]
    bodies = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")
    rows = decode_events(bodies).orderBy("i").select("accepted", "reason").collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in cases]


def test_published_batches_decode_to_the_same_events(spark):
    sent = [batch("b", event(event=""), event(id="x", received_at=3, properties={"k": [1, {"a": None}]})), batch("c")]
    over = batch("d", *[event()] * 3)
    decoded = decode_batches(messages(spark, [*sent, over, "{"]))
    queued = publish(enforce_batch_limit(decoded, 2))
    again = decode_batches(queued)
    shown = ["message_id", "batch_id", "to_json(events) AS events"]
    assert [r.message_id for r in queued.orderBy("message_id").collect()] == ["m0", "m1"]
    assert again.selectExpr(*shown).collect() == decoded.filter("message_order < 2").selectExpr(*shown).collect()


def test_kafka_records(spark):
    raw = spark.sql(
        "SELECT CAST('b' AS BINARY) AS key, CAST('{}' AS BINARY) AS value, 3 AS partition, 7L AS offset, "
        "TIMESTAMP '1970-01-01 00:00:01' AS timestamp"
    )
    assert [tuple(r) for r in kafka_messages(raw).collect()] == [("3-7", 7, "b", "{}")]


def test_ids_are_no_exponents(spark):
    """Only a digit can have an exponent: ids of a letter and a number do not cost a search for numbers."""
    texts = {
        '{"id":"e123456"}': False, '{"id":"type1234","x":1e30}': False, "[1e400]": True, "[-1.5E+999]": True, '["7e123"]': True,
        "[" + "1" * 310 + "]": True,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
        "t", f"{J.may_hold_infinite_number('t')} AS may", f"{J.has_infinite_number('t')} AS found"
    ).collect()
    assert {r.t: r.may for r in rows} == texts
    assert {r.t: r.found for r in rows} == {t: may and '"' not in t for t, may in texts.items()}
