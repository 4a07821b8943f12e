"""Random inputs against small models in plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from batchloom import schemas as S
from batchloom.functions.contains import json_contains
from batchloom.operators.decode import decode_batches
from batchloom.operators.validate import validate_batches
from batchloom.sources.store import EventStore
from batchloom.streaming.ingest import process_epoch
from helpers import batch, event

INT64 = range(-(2**63), 2**63)


def _random_value(rng):
    return rng.choice([
        None, "", "x", "é\"\\", 0, 5, -1, 2**63 - 1, 2**63, 1.5, True, [], [1], {}, {"a": [1, None, {"b": 2.5}]},
    ])


def _good_value(rng, kind):
    if rng.random() < 0.25:
        return None
    if kind == "integer":
        return rng.choice([0, -3, 1, 1_700_000_000_000])
    if kind == "object":
        return rng.choice([{}, {"k": 1}, {"z": "q", "a": {"y": None}}])
    return rng.choice(["", " ", "x", "café"])


def _random_key(rng, key):
    return rng.choice([key, key, key, key.upper(), key.title()])


def _random_event(rng, wild):
    if rng.random() < 0.05:
        return rng.choice([None, None, 5, [], "x"]) if wild else None
    fields = {}
    for key, _, kind in S.EVENT_FIELDS:
        if rng.random() < 0.7:
            value = _random_value(rng) if wild and rng.random() < 0.06 else _good_value(rng, kind)
            fields[_random_key(rng, key)] = value
    if rng.random() < 0.3:
        fields["other"] = _random_value(rng)
    return fields


def _random_payload(rng):
    wild = rng.random() < 0.5
    events = [_random_event(rng, wild) for _ in range(rng.randrange(4))]
    fields = {_random_key(rng, "batch_id"): rng.choice(["", "b", "b", None] + ([5] if wild else []))}
    fields[_random_key(rng, "events")] = rng.choice([events] * 6 + [None] + ([{}, "x"] if wild else []))
    text = json.dumps(fields, ensure_ascii=rng.random() < 0.5)
    return text[:-1] if rng.random() < 0.03 else text


class _Fails(Exception):
    pass


def _model_field(value, kind):
    if value is None:
        return {"text": "", "integer": 0}.get(kind)
    if kind == "object":
        fits = isinstance(value, dict)
    elif kind == "integer":
        fits = type(value) is int and value in INT64
    else:
        fits = isinstance(value, str)
    if not fits:
        raise _Fails
    return value


def _model_event(value):
    if value is None:
        value = {}
    if not isinstance(value, dict):
        raise _Fails
    folded = {k.lower(): v for k, v in value.items()}
    return {column: _model_field(folded.get(key), kind) for key, column, kind in S.EVENT_FIELDS}


def _model_batch(text):
    try:
        folded = {k.lower(): v for k, v in json.loads(text).items()}
        batch_id = _model_field(folded.get("batch_id"), "text")
        events = folded.get("events")
        if events is not None and not isinstance(events, list):
            raise _Fails
        return batch_id, [_model_event(e) for e in events or []]
    except (ValueError, _Fails):
        return None


def _model_error(e):
    if e["name"] == "":
        return S.NAME_REQUIRED
    if e["timestamp_ms"] <= 0:
        return S.TIMESTAMP_REQUIRED
    if e["project_id"] == "":
        return S.PROJECT_REQUIRED
    return S.ORGANIZATION_REQUIRED if e["org_id"] == "" else None


def test_random_payloads(spark):
    rng = random.Random(7)
    texts = [_random_payload(rng) for _ in range(1500)]
    rows = [(f"m{i}", i, "e", t) for i, t in enumerate(texts)]
    checked = validate_batches(decode_batches(spark.createDataFrame(rows, S.MESSAGE)))
    found = checked.orderBy("message_order").selectExpr(
        "decode_error", "batch_id", "valid_events", "invalid_events", "reason",
        "to_json(events, map('ignoreNullFields', 'false')) AS events",
    ).collect()
    decoded = 0
    for text, row in zip(texts, found, strict=True):
        model = _model_batch(text)
        assert (row.decode_error is None) == (model is not None), text
        if model is None:
            continue
        decoded += 1
        batch_id, events = model
        assert row.batch_id == batch_id, text
        assert json.loads(row.events) == events, text
        valid = sum(_model_error(e) is None for e in events)
        if batch_id == "":
            expected = (0, 0, S.MISSING_BATCH_ID)
        elif not events:
            expected = (0, 0, S.EMPTY_BATCH)
        else:
            expected = (valid, len(events) - valid, None if valid else S.NO_VALID_EVENTS)
        assert (row.valid_events, row.invalid_events, row.reason) == expected, text
    assert 500 < decoded < 1400


def test_random_deliveries(spark, tmp_path):
    rng = random.Random(11)
    store = EventStore(str(tmp_path / "store")).create(spark)
    owners, expected, stored = {}, {}, 0
    for epoch in range(3):
        rows = []
        for i in range(60):
            good = rng.randrange(3)
            events = [event(timestamp=rng.randrange(1, 3)) for _ in range(good)] + [event(event="")] * rng.randrange(2)
            rows.append((f"m{epoch}-{i}", i, "e", batch(f"b{rng.randrange(12)}", *events), events))
        for message_id, _, _, text, events in rows:
            contents = json.dumps([e for e in events if e["event"]])
            batch_id = json.loads(text)["batch_id"]
            if contents == "[]":
                expected[message_id] = "rejected"
            elif batch_id not in owners:
                owners[batch_id] = contents
                expected[message_id] = "new"
                stored += len(json.loads(contents))
            else:
                expected[message_id] = "duplicate" if owners[batch_id] == contents else "conflict"
        shuffled = rng.sample(rows, len(rows))
        process_epoch(store, spark.createDataFrame([r[:4] for r in shuffled], S.MESSAGE), epoch)
    assert {r.message_id: r.status for r in store.read(spark, "outcomes").collect()} == expected
    assert sorted(r.batch_id for r in store.read(spark, "batches").collect()) == sorted(owners)
    assert store.read(spark, "events").count() == stored


def _random_document(rng, depth):
    if depth == 0 or rng.random() < 0.4:
        return rng.choice([None, True, False, 0, 1, 1.5, 1.0, "a", "1", ""])
    if rng.random() < 0.5:
        return [_random_document(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "b", "c.d"]): _random_document(rng, depth - 1) for _ in range(rng.randrange(3))}


def _is_number(value):
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _model_contains(document, pattern, top=True):
    if isinstance(pattern, dict):
        return isinstance(document, dict) and all(
            k in document and _model_contains(document[k], v, False) for k, v in pattern.items()
        )
    if isinstance(pattern, list):
        return isinstance(document, list) and all(
            any(_model_contains(e, p, False) for e in document) for p in pattern
        )
    if isinstance(document, list):
        return top and any(_model_contains(e, pattern, False) for e in document)
    if _is_number(document) and _is_number(pattern):
        return document == pattern
    return type(document) is type(pattern) and document == pattern


@pytest.mark.parametrize("seed", range(3))
def test_random_containment(spark, seed):
    rng = random.Random(seed)
    documents = [_random_document(rng, 3) for _ in range(400)]
    patterns = [_random_document(rng, 3) for _ in range(12)]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, text string")
    tests = [json_contains(F.col("doc"), p).alias(f"p{n}") for n, p in enumerate(patterns)]
    rows = frame.withColumn("doc", F.parse_json("text")).select("i", *tests).collect()
    hits = 0
    for row in rows:
        for n, pattern in enumerate(patterns):
            expected = _model_contains(documents[row.i], pattern)
            hits += expected
            assert row[f"p{n}"] is expected, (documents[row.i], pattern)
    assert hits
