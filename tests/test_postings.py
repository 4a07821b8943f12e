"""Containment lookups with postings give what they give without, and read less."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_contains import CASES

from batchloom.functions.contains import json_contains
from batchloom.operators import postings as P
from batchloom.operators.layout import DAY_MS
from batchloom.sources import store as store_module
from batchloom.sources.store import EventStore
from batchloom.streaming.ingest import process_epoch
from helpers import batch, event, messages, scan_of


def test_a_document_has_all_terms_of_what_it_contains(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    terms = docs.select("i", P.document_terms("parse_json(text)").alias("terms"))
    has_all = [
        F.when(F.col("i") == i, F.size(F.array_except(F.array(*t), "terms")) == 0)
        for i, c in enumerate(CASES) if (t := P.pattern_terms(c[1]))
    ]
    found = {r.i: r.all for r in terms.select("i", F.coalesce(*has_all).alias("all")).collect()}
    for i, (text, pattern, contains) in enumerate(CASES):
        if contains and isinstance(pattern, (dict, list)):
            assert found[i] is True, (text, pattern)
        if not contains and pattern in ({"a": [4]}, {"a": "1"}, {"a": None}):
            assert found[i] is False, (text, pattern)


def test_paths_are_not_mixed_up(spark):
    """Keys that hold the signs of paths, arrays in arrays, and what lies deeper than paths are followed."""
    texts = ['{"a":{"b":1}}', '{"a.1:b":1}', '{"a":[[1]]}', '{"a":[1]}', '{"a[]":1}', '{"a":{"b":{"c":{"d":{"e":1}}}}}', '{"a":{"b":{"c":{"d":{"e":2}}}}}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.document_terms("parse_json(t)").alias("x")).collect()
    assert len({frozenset(r.x) for r in rows}) == 6  # the last two differ below
    assert frozenset(rows[5].x) == frozenset(rows[6].x)
    assert all(len(set(r.x)) == len(r.x) for r in rows)


@pytest.mark.parametrize("numbers, most, runs", [
    ({5}, 4, [(5, 5)]), ({1, 2, 3, 7}, 4, [(1, 3), (7, 7)]), ({1, 3, 10, 30}, 2, [(1, 10), (30, 30)]),
    ({1, 3, 10, 30}, 1, [(1, 30)]), ({1, 3, 10, 30}, 9, [(1, 1), (3, 3), (10, 10), (30, 30)]),
])
def test_runs(numbers, most, runs):
    assert P.merged_runs(numbers, most) == runs


def _properties(rng, i):
    kinds = [
        {"button": f"b{rng.randrange(40)}", "n": rng.choice([1, 1.0, 2, 2.5, -0.0, 0])},
        {"list": [rng.randrange(5), {"in": {"k": rng.randrange(30)}}], "button": None},
        {"deep": {"er": {"and": {"more": {"below": rng.randrange(3)}}}}, "ok": rng.random() < 0.1},
        {"i": i, "it's": [], "a]": {}}, {}, None,
    ]
    return rng.choice(kinds)


PATTERNS = [
    {"button": "b7"}, {"n": 1}, {"n": 0}, {"button": "b7", "n": 2.5}, {"list": [{"in": {"k": 3}}]}, {"list": [4, {"in": {}}]},
    {"button": None}, {"deep": {"er": {"and": {"more": {"below": 2}}}}}, {"ok": True}, {"it's": []}, {"a]": {}}, {}, [], {"i": 77},
    {"i": 77.0}, {"i": "77"}, {"nothing": 1}, {"list": []}, None, 5, {"deep": {"er": []}},
]


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """Two indexed epochs of one stream and one of another; then a further epoch of each without postings."""
    store = EventStore(str(tmp_path_factory.mktemp("postings") / "store")).create(spark)
    other = EventStore(store.root, "other")
    rng = random.Random(1)

    def send(to, epoch, n):
        events = [event(properties=_properties(rng, i), timestamp=1 + i % 6 * DAY_MS) for i in range(n)]
        process_epoch(to, messages(spark, [batch(f"{to.stream}-{epoch}-{k}", *events[k::5]) for k in range(5)]), epoch)

    send(store, 0, 200)
    store.index(spark)
    send(store, 1, 100)
    send(other, 0, 100)
    store.index(spark)
    store.index(spark)
    send(other, 1, 50)
    send(store, 2, 50)
    return store


def _rows(frame):
    return sorted((r.batch_id, r.event_index, r.p) for r in frame.select("batch_id", "event_index", F.to_json("properties").alias("p")).collect())


def test_a_broken_off_index_changes_nothing(spark, tmp_path, monkeypatch):
    store = EventStore(str(tmp_path / "store")).create(spark)
    for epoch in range(3):
        process_epoch(store, messages(spark, [batch(f"b{epoch}", event(properties={"a": 1}), event(properties={"a": 2}))]), epoch)
        if epoch == 0:
            store.index(spark)
        if epoch == 1:
            with monkeypatch.context() as patch:
                patch.setattr(store_module.EventStore, "_mark", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    store.index(spark)
        assert sorted(r.batch_id for r in store.find(spark, {"a": 2}).collect()) == [f"b{e}" for e in range(epoch + 1)]
    store.index(spark)
    assert store.find(spark, {"a": 2}).count() == 3


@pytest.mark.parametrize("most_parts", [1_000, 0])
def test_same_rows_with_and_without(spark, stores, monkeypatch, most_parts):
    monkeypatch.setattr(store_module, "MOST_PARTS", most_parts)
    events = stores.read(spark, "events")
    some = 0
    for pattern in PATTERNS if most_parts else PATTERNS[:6]:
        found = _rows(stores.find(spark, pattern))
        assert found == _rows(events.filter(json_contains(F.col("properties"), pattern))), json.dumps(pattern)
        some += bool(found)
    assert some >= 5


def test_no_store_without_postings(spark, tmp_path):
    store = EventStore(str(tmp_path / "store")).create(spark)
    assert store.find(spark, {"a": 1}).isEmpty()
    process_epoch(store, messages(spark, [batch("b", event(properties={"a": 1}), event(properties={"a": 2}))]), 0)
    assert [r.event_index for r in store.find(spark, {"a": 1}).collect()] == [0]
    store.index(spark)
    assert [r.event_index for r in store.find(spark, {"a": 2}).collect()] == [1]


def test_fewer_rows_and_files_are_read(spark, tmp_path, monkeypatch, long_metadata):
    """One rare value in many days and parts: one file is opened, and one part of it is read."""
    monkeypatch.setattr(store_module, "PART_BITS", 5)
    spark.conf.set("parquet.block.size", "4096")
    spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 4096)
    try:
        store = EventStore(str(tmp_path / "store")).create(spark)
        events = [event(properties={"k": i}, timestamp=1 + i % 8 * DAY_MS, user_id=f"u{i}") for i in range(4_000)]
        process_epoch(store, messages(spark, [batch(f"b{k}", *events[k::20]) for k in range(20)]), 0)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    plain = store.read(spark, "events").filter(json_contains(F.col("properties"), {"k": 1234}))
    rows, _, files = scan_of(plain.select("batch_id"), "events")
    store.index(spark)
    found, scan, less = scan_of(store.find(spark, {"k": 1234}).select("batch_id"), "events")
    assert found == rows and len(found) == 1
    assert (files, less) == (8, 1) and "GreaterThanOrEqual(part" in scan or "EqualTo(part" in scan
