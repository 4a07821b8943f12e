"""Ledger, store and stream."""

import itertools
import json

import pytest

from batchloom import schemas as S
from batchloom.operators import ledger as L
from batchloom.operators import lookups, spread
from batchloom.plans import inputs
from batchloom.sources import store as store_module
from batchloom.sources.messages import read_batch_messages, stream_batch_messages, with_stream_order
from batchloom.sources.store import EventStore
from batchloom.sources.synth import batch_numbers, synth_batches, synth_messages
from batchloom.streaming import ingest
from batchloom.streaming.ingest import append_batches, drain, prepare, process_epoch
from helpers import batch, event, messages

SF = "/root/testdata/sf0.001"
_names = itertools.count()


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(str(tmp_path / "store")).create(spark)


def _statuses(store, spark):
    return {r.message_id: r.status for r in store.read(spark, "outcomes").collect()}


def _committed(store, spark):
    return sum(last - first + 1 for first, last in store.snapshot(spark).values())


def _events(store, spark):
    rows = store.read(spark, "events").drop("created_at").selectExpr("* EXCEPT (properties, context)",
        "to_json(properties) AS properties", "to_json(context) AS context").collect()
    return sorted(map(str, rows))


def _ingest(spark, store, payloads, epoch=0):
    process_epoch(store, messages(spark, payloads), epoch)
    return [s for _, s in sorted(_statuses(store, spark).items(), key=lambda kv: int(kv[0][1:]))]


HASH_CASES = {
    "other key order": (batch("b", event(properties={"a": 1, "b": 2})), batch("b", event(properties={"b": 2, "a": 1})), "duplicate"),
    "swapped events": (batch("b", event(timestamp=1), event(timestamp=2)), batch("b", event(timestamp=2), event(timestamp=1)), "conflict"),
    "other invalid events": (batch("b", event()), batch("b", event(event=""), event(), event(orgid="")), "duplicate"),
    "empty id and receipt time": (batch("b", event()), batch("b", event(id="", received_at=0)), "duplicate"),
    "receipt time": (batch("b", event()), batch("b", event(received_at=7)), "conflict"),
    "no properties against empty ones": (batch("b", event()), batch("b", event(properties={})), "conflict"),
    "no user against empty user": (batch("b", event()), batch("b", event(user_id="")), "conflict"),
    "null user": (batch("b", event()), batch("b", event(user_id=None)), "duplicate"),
    "decimal spelling": (batch("b", event(properties={"a": 1})), '{"batch_id":"b","events":[{"event":"click","timestamp":1,"projectid":"p","orgid":"o","properties":{"a":1.0}}]}', "duplicate"),
}


def test_content_hash_classes(spark):
    pairs = [p for first, second, _ in HASH_CASES.values() for p in (first, second)]
    hashes = [r.payload_hash for r in prepare(messages(spark, pairs)).orderBy("message_order").collect()]
    assert all(len(h) == 64 for h in hashes)
    for i, (name, (_, _, verdict)) in enumerate(HASH_CASES.items()):
        assert (hashes[2 * i] == hashes[2 * i + 1]) == (verdict == "duplicate"), name


def test_first_writer_wins_inside_an_epoch(spark, store):
    good, other = batch("b", event()), batch("b", event(orgid="q"))
    no_valid = batch("b", event(event=""))
    assert _ingest(spark, store, [no_valid, good, other, good, batch("c", event())]) == [
        "rejected", "new", "conflict", "duplicate", "new",
    ]
    assert sorted(r.batch_id for r in store.read(spark, "batches").collect()) == ["b", "c"]
    quarantine = {r.message_id: (r.reason, r.payload) for r in store.read(spark, "quarantine").collect()}
    assert quarantine == {"m0": (S.NO_VALID_EVENTS, no_valid), "m2": (S.CONFLICT, other)}


def test_first_writer_wins_across_epochs(spark, store):
    good, other = batch("b", event()), batch("b", event(orgid="q"))
    process_epoch(store, messages(spark, [good]), 0)
    before = store.read(spark, "batches").collect()
    rows = [("m10", 0, "b", other), ("m11", 1, "b", good), ("m12", 2, "c", batch("c", event()))]
    process_epoch(store, spark.createDataFrame(rows, S.MESSAGE), 1)
    assert _statuses(store, spark) == {"m0": "new", "m10": "conflict", "m11": "duplicate", "m12": "new"}
    assert [r for r in store.read(spark, "batches").collect() if r.batch_id == "b"] == before
    assert store.read(spark, "events").count() == 2


def test_conflicts_say_where(spark, store):
    """Changed, added, missing and swapped events; invalid ones don't count; one batch in conflict many times."""
    e = [event(timestamp=i + 1, properties={"n": i}) for i in range(4)]
    process_epoch(store, messages(spark, [batch("b", *e), batch("c", e[0])]), 0)
    sent = {
        "m10": ("b", batch("b", e[0], event(timestamp=2, properties={"n": 1.5}), e[2], e[3]), [1]),
        "m11": ("b", batch("b", *e, event(timestamp=9)), [4]),
        "m12": ("b", batch("b", e[0], e[1]), [2, 3]),
        "m13": ("b", batch("b", e[1], e[0], e[2], e[3]), [0, 1]),
        "m14": ("b", batch("b", event(event=""), e[0], e[1], e[2], event(timestamp=4, properties={"n": "3"})), [3]),
        "m15": ("c", batch("c", event(timestamp=1, properties={"n": 0}, user_id="")), [0]),
        "m16": ("b", batch("b", *e), None),  # a copy
        "m17": ("b", batch("b", event(timestamp=1, properties={"n": 0.0}), *e[1:]), None),  # equal by value
    }
    rows = [(m, i, b, payload) for i, (m, (b, payload, _)) in enumerate(sent.items())]
    process_epoch(store, spark.createDataFrame(rows, S.MESSAGE), 1)
    found = {r.message_id: r.places for r in ingest.quarantined_conflicts(store, spark).collect()}
    assert found == {m: places for m, (_, _, places) in sent.items() if places is not None}


def test_same_message_id_twice(spark, store):
    payload = batch("b", event())
    rows = [("m0", 0, "b", payload)] * 3
    process_epoch(store, spark.createDataFrame(rows, S.MESSAGE), 0)
    assert sorted(r.status for r in store.read(spark, "outcomes").collect()) == ["duplicate", "duplicate", "new"]
    assert store.read(spark, "events").count() == 1


def test_different_contents_under_one_message_id(spark, store):
    first, other, later = batch("b", event()), batch("b", event(orgid="q")), batch("c", event())
    rows = [("m0", 0, "b", first), ("m0", 1, "b", other), ("m0", 2, "b", later), ("m0", 3, "b", other), (None, 4, "b", other)]
    process_epoch(store, spark.createDataFrame(rows, S.MESSAGE), 0)
    statuses = sorted((r.message_id, r.status) for r in store.read(spark, "outcomes").collect())
    assert statuses == [("", "conflict"), ("m0", "conflict"), ("m0", "conflict"), ("m0", "new"), ("m0", "new")]
    quarantine = sorted((r.message_id, r.payload) for r in store.read(spark, "quarantine").collect())
    assert quarantine == [("", other), ("m0", other), ("m0", other)]


def test_envelopes(spark, store):
    good = batch("inner", event())
    rows = [("m0", 0, None, good), ("m1", 1, "b", None), ("m2", 2, "outer", good), ("m3", 3, "b", "{")]
    process_epoch(store, spark.createDataFrame(rows, S.MESSAGE), 0)
    assert {r.message_id: r.reason for r in store.read(spark, "quarantine").collect()} == {
        "m0": S.BAD_ENVELOPE_ID, "m1": S.BAD_ENVELOPE_PAYLOAD, "m3": S.INVALID_JSON,
    }
    assert [r.batch_id for r in store.read(spark, "batches").collect()] == ["inner"]


def test_admission_limit(spark, store):
    process_epoch(store, messages(spark, [batch("b", event(), event()), batch("c", event())]), 0, max_events=1)
    assert _statuses(store, spark) == {"m0": "rejected", "m1": "new"}


def test_stream_ids_order_as_numbers(spark, store):
    first, later = batch("b", event()), batch("b", event(orgid="q"))
    rows = [("10-2", "b", later), ("9-11", "b", later), ("9-2", "b", first)]
    envelopes = spark.createDataFrame(rows, "message_id string, batch_id string, payload string")
    process_epoch(store, with_stream_order(envelopes), 0)
    assert _statuses(store, spark) == {"9-2": "new", "9-11": "conflict", "10-2": "conflict"}


@pytest.mark.parametrize("limit", [None, 0])
def test_hot_batch_id(spark, store, monkeypatch, limit):
    """One id holds most messages, both as copies and as conflicts; with and without broadcasts."""
    if limit is not None:
        monkeypatch.setattr(ingest, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(spread, "fits_broadcast", lambda *_: False)
        monkeypatch.setattr(ingest, "is_small", lambda *_: False)
        monkeypatch.setattr(spread, "ROWS_PER_SALT", 50)
    copies = [batch("hot", event())] * 200
    conflicts = [batch("hot", event(timestamp=i + 2)) for i in range(200)]
    rest = [batch(f"c{i}", event()) for i in range(50)]
    process_epoch(store, messages(spark, copies + conflicts + rest), 0)
    counts = {r["status"]: r["count"] for r in store.read(spark, "outcomes").groupBy("status").count().collect()}
    assert counts == {"new": 51, "duplicate": 199, "conflict": 200}
    assert store.read(spark, "quarantine").count() == 200
    assert store.read(spark, "events").count() == 51


def test_replaying_an_epoch_changes_nothing(spark, store):
    m = messages(spark, [batch("b", event()), batch("c", event(), event(event=""))])
    process_epoch(store, m, 0)
    before = _events(store, spark)
    process_epoch(store, m, 0)
    process_epoch(store, m, 1)
    assert _events(store, spark) == before
    assert store.read(spark, "batches").count() == 2


def test_epochs_come_in_order(spark, store):
    process_epoch(store, messages(spark, [batch("a", event())]), 3)
    with pytest.raises(ValueError):
        process_epoch(store, messages(spark, [batch("b", event())]), 2)
    process_epoch(EventStore(store.root, "other"), messages(spark, [batch("b", event())]), 2)
    assert store.read(spark, "events").count() == 2


def test_a_read_is_a_snapshot(spark, store):
    process_epoch(store, messages(spark, [batch("a", event())]), 0)
    before = store.read(spark, "events")
    process_epoch(store, messages(spark, [batch("b", event())]), 1)
    assert (before.count(), store.read(spark, "events").count()) == (1, 2)


def test_crash_between_writes(spark, store, monkeypatch):
    """One epoch that breaks off before each of its writes in turn, then runs through."""
    process_epoch(store, messages(spark, [batch("a", event())]), 0)
    m = messages(spark, [batch("b", event()), batch("b", event(orgid="q")), batch("a", event()), ""])
    write = EventStore.write
    for broken_at in ["outcomes", "events", "quarantine", "batches", "commits"]:

        def crash(self, table, epoch, rows, broken_at=broken_at):
            if table == broken_at:
                raise RuntimeError("lost")
            write(self, table, epoch, rows)

        def crash_at_commit(self, *_):
            raise RuntimeError("lost")

        with monkeypatch.context() as patch:
            patch.setattr(store_module.EventStore, "write", crash)
            if broken_at == "commits":
                patch.setattr(store_module.EventStore, "commit", crash_at_commit)
            with pytest.raises(RuntimeError):
                process_epoch(store, m, 1)
        for table in ["events", "batches", "outcomes"]:
            assert store.read(spark, table).count() == 1, (broken_at, table)
        assert store.read(spark, "quarantine").isEmpty()
    process_epoch(store, m, 1)
    assert sorted(r.status for r in store.read(spark, "outcomes").collect()) == [
        "conflict", "duplicate", "new", "new", "rejected",
    ]
    assert sorted(r.batch_id for r in store.read(spark, "batches").collect()) == ["a", "b"]
    assert store.read(spark, "events").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    landed = str(tmp_path / "messages")
    built = inputs.build_messages(spark, SF)
    for part in range(3):
        cut = built.filter(f"(message_order div 10) % 3 = {part}")
        cut.coalesce(1).write.mode("append").json(landed)
    streamed = EventStore(str(tmp_path / "streamed"))
    checkpoint = str(tmp_path / "checkpoint")
    assert drain(streamed, stream_batch_messages(spark, landed, max_files=1), checkpoint)
    assert _committed(streamed, spark) == 3
    assert drain(streamed, stream_batch_messages(spark, landed, max_files=1), checkpoint)
    assert _committed(streamed, spark) == 3
    before = _events(streamed, spark)
    assert drain(streamed, stream_batch_messages(spark, landed), str(tmp_path / "fresh-checkpoint"))
    assert _committed(streamed, spark) == 4
    again = streamed.read(spark, "outcomes").groupBy("message_id").count()
    assert again.filter("count <> 2").isEmpty() and _events(streamed, spark) == before
    streamed_once = EventStore(str(tmp_path / "once"))
    drain(streamed_once, stream_batch_messages(spark, landed, max_files=2), str(tmp_path / "once-checkpoint"))
    whole = EventStore(str(tmp_path / "whole")).create(spark)
    process_epoch(whole, read_batch_messages(spark, landed), 0)
    assert before == _events(whole, spark) == _events(streamed_once, spark)
    assert _statuses(streamed_once, spark) == _statuses(whole, spark)
    counts = {r["status"]: r["count"] for r in whole.read(spark, "outcomes").groupBy("status").count().collect()}
    assert counts == {"new": 37, "duplicate": 8, "conflict": 4, "rejected": 3}
    assert L.orphan_events(whole.read(spark, "events"), whole.read(spark, "batches")).isEmpty()


def test_live_lag(spark, tmp_path):
    landed = str(tmp_path / "messages")
    for name in ("a", "b"):
        messages(spark, [batch(name, event())]).coalesce(1).write.mode("append").json(landed)
    store = EventStore(str(tmp_path / "store"))
    stream = stream_batch_messages(spark, landed, max_files=1)
    query = ingest.ingest_stream(store, stream, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination()
    assert ingest.live_lag(query) == {"messages": 1, "files": 0, "bytes": 0}
    assert [p.numInputRows for p in query.recentProgress] == [1, 1]


def test_append_backend_keeps_copies(spark, tmp_path):
    landed, path = str(tmp_path / "messages"), str(tmp_path / "appended")
    payload = batch("b", event(event=""), event())
    messages(spark, [payload, payload, batch("c")]).coalesce(1).write.json(landed)
    append_batches(stream_batch_messages(spark, landed), path, str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(path).collect()
    assert [(r.batch_id, len(r.events)) for r in rows] == [("b", 1), ("b", 1)]


def test_an_epoch_takes_few_jobs(spark, store):
    """Counts are taken while tables are written, not by reading them again."""
    process_epoch(store, messages(spark, [batch("a", event())]), 0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("epoch", "")
    process_epoch(store, messages(spark, [batch("a", event()), batch("b", event(), event()), "{", batch("b", event(), event())]), 1)
    spark.sparkContext.setJobGroup("other", "")
    assert 0 < len(tracker.getJobIdsForGroup("epoch")) <= 15
    assert sorted(r.status for r in store.read(spark, "outcomes").collect()) == ["duplicate", "duplicate", "new", "new", "rejected"]


def test_synthetic_load(spark, store):
    made = synth_batches(batch_numbers(spark, 200), 7, 0.1, 1_700_000_000_000)
    process_epoch(store, synth_messages(made), 0)
    totals = store.read(spark, "outcomes").selectExpr(
        "sum(total_events) AS total", "sum(valid_events) AS valid", "sum(invalid_events) AS invalid"
    ).collect()[0]
    invalid = sum(((b + i) % 1000) / 1000 < 0.1 for b in range(1, 201) for i in range(7))
    assert totals.total == 1400 and totals.invalid == invalid and totals.valid == 1400 - invalid
    dense = store.read(spark, "events").groupBy("batch_id").agg({"event_index": "max", "*": "count"})
    assert dense.filter("`max(event_index)` + 1 <> `count(1)`").isEmpty()


def test_generator_rate(spark):
    made = synth_batches(batch_numbers(spark, 1), 3, 0.002, 5).collect()[0]
    assert made.batch_id == "stress-5-1"
    assert [e.event for e in made.events] == ["", "stress_event", "stress_event"]
    assert [e.properties.sequence for e in made.events] == [0, 1, 2]
    assert json.loads(synth_messages(synth_batches(batch_numbers(spark, 1), 1, 0, 5)).collect()[0].payload)["events"][0]["orgid"] == "stress_org"
    with pytest.raises(ValueError):
        synth_batches(batch_numbers(spark, 1), 0, 0.0, 5)
    with pytest.raises(ValueError):
        synth_batches(batch_numbers(spark, 1), 1, 1.5, 5)
    with pytest.raises(ValueError):
        batch_numbers(spark, 0)


def test_a_new_stream_goes_on_after_another(spark, tmp_path):
    """The second stream's epochs have the same numbers, and its batches meet those of the first."""
    root = str(tmp_path / "store")
    one, two = EventStore(root, "one").create(spark), EventStore(root, "two")
    process_epoch(one, messages(spark, [batch("x", event()), batch("z", event())]), 0)
    process_epoch(two, messages(spark, [batch("x", event(orgid="q")), batch("y", event())]), 0)
    process_epoch(two, messages(spark, [batch("z", event())]), 1)
    assert sorted(r.batch_id for r in one.read(spark, "batches").collect()) == ["x", "y", "z"]
    assert one.snapshot(spark) == {"one": (0, 0), "two": (0, 1)}
    assert sorted(r.status for r in one.read(spark, "outcomes").collect()) == ["conflict", "duplicate", "new", "new", "new"]


def test_one_marker_per_stream(spark, store, tmp_path):
    snapshot = store.snapshot(spark)
    for epoch in range(5, 12):
        assert not store.is_committed(snapshot, epoch)
        store.commit(spark, epoch, snapshot)
        snapshot = store.snapshot(spark)
        assert snapshot == {"batch": (5, epoch)} and store.is_committed(snapshot, epoch)
    assert [p.name for p in (tmp_path / "store" / "commits" / "batch").iterdir() if not p.name.startswith(".")] == ["5-11"]
    # A marker whose removal was missed changes nothing.
    (tmp_path / "store" / "commits" / "batch" / "5-9").touch()
    assert store.snapshot(spark) == {"batch": (5, 11)}
    store.commit(spark, 12, snapshot)
    assert store.snapshot(spark) == {"batch": (5, 12)}
    with pytest.raises(ValueError):
        store.is_committed({"batch": (5, 11)}, 13)


def test_a_crash_between_marker_and_clean_up(spark, store, monkeypatch):
    process_epoch(store, messages(spark, [batch("a", event())]), 0)
    children = store_module._children

    def broken(spark, path):
        if path.endswith("commits/batch"):
            raise RuntimeError("lost")
        return children(spark, path)

    snapshot = store.snapshot(spark)
    with monkeypatch.context() as patch:
        patch.setattr(store_module, "_children", broken)
        with pytest.raises(RuntimeError):
            store.commit(spark, 1, snapshot)
    assert store.snapshot(spark) == {"batch": (0, 1)}


def test_a_broken_off_epoch_leaves_nothing(spark, store):
    """The first try wrote other ledger rows and event days than the second one."""
    process_epoch(store, messages(spark, [batch("a", event())]), 0)
    rows = spark.createDataFrame([(f"b{i}", "h", None) for i in range(50)], S.BATCHES)
    store.write("batches", 1, rows)
    moved = store.read(spark, "events").selectExpr("* EXCEPT (timestamp_ms)", "1000000000000L AS timestamp_ms")
    store.write("events", 1, moved)
    process_epoch(store, messages(spark, [batch("c", event())]), 1)
    assert sorted(r.batch_id for r in store.read(spark, "batches").collect()) == ["a", "c"]
    assert sorted(r.batch_id for r in store.read(spark, "events").collect()) == ["a", "c"]


def test_rewriting_changes_no_result(spark, tmp_path):
    store = EventStore(str(tmp_path / "store")).create(spark)
    for epoch in range(4):
        process_epoch(store, messages(spark, [batch(f"b{epoch}", event(), event()), batch("b0", event(), event()), "{"]), epoch)

    def rows(of):
        return {t: sorted(map(str, of.read(spark, t).drop("properties", "context").collect())) for t in store_module.TABLES}

    made = store.rewrite(spark, str(tmp_path / "made"))
    assert rows(made) == rows(store)
    assert len(list((tmp_path / "made" / "events").glob("stream=*/epoch=*/*/*.parquet"))) == 1
    process_epoch(made, messages(spark, [batch("b2", event(orgid="z"))]), 3)  # done already
    process_epoch(made, messages(spark, [batch("b2", event(orgid="z")), batch("c", event())]), 4)
    assert sorted(r.batch_id for r in made.read(spark, "batches").collect()) == ["b0", "b1", "b2", "b3", "c"]
    again = made.rewrite(spark, str(tmp_path / "again"))
    assert rows(again) == rows(made) and again.snapshot(spark)["batch"] == (0, 4)


def test_a_new_session_reads_the_same_ledger(spark, store):
    """The session's catalog is forgotten; the folders say how many buckets there are."""
    process_epoch(store, messages(spark, [batch("a", event()), batch("b", event())]), 0)
    spark.sql(f"DROP TABLE {store._ledger(spark)}")
    process_epoch(store, messages(spark, [batch("a", event()), batch("c", event())]), 1)
    assert sorted(r.batch_id for r in store.read(spark, "batches").collect()) == ["a", "b", "c"]


def test_lookups_find_what_plain_filters_find(spark, store):
    """Days before, inside and beyond the range of the folders, ids that share cells, and rows without a user."""
    times = [1, 86_399_999, 86_400_000, 1_700_000_000_000, 4_102_444_799_999, 4_102_444_800_000, 9 * 10**18]
    events = [
        event(timestamp=t, projectid=f"p{i % 7}", orgid=f"o{i % 5}", user_id=None if i % 3 == 0 else f"u{i % 11}", funnelid=f"f{i % 2}")
        for i, t in enumerate(times * 12)
    ]
    process_epoch(store, messages(spark, [batch(f"b{i}", *events[i::4]) for i in range(4)]), 0)
    stored = store.read(spark, "events")
    rows = [r.asDict() for r in stored.collect()]

    def same(found, keep):
        assert sorted((r.batch_id, r.event_index) for r in found.collect()) == sorted(
            (r["batch_id"], r["event_index"]) for r in rows if keep(r)
        )

    for low, high in [(None, None), (0, 86_399_999), (2, 86_400_000), (4_102_444_799_999, 4_102_444_800_000), (4_102_444_800_000, 2**63 - 1), (-5, 1), (86_400_000, 86_399_999)]:
        def inside(r, low=low, high=high):
            return (low is None or r["timestamp_ms"] >= low) and (high is None or r["timestamp_ms"] <= high)

        same(lookups.funnel_timeline(stored, "f1", low, high), lambda r: r["funnel_id"] == "f1" and inside(r))
        same(lookups.events_by_user_time(stored, "u4", low, high), lambda r: r["user_id"] == "u4" and inside(r))
        if low is not None:
            same(lookups.events_by_org_time(stored, "o3", low, high), lambda r: r["org_id"] == "o3" and inside(r))
            same(lookups.events_by_project_time(stored, "p2", "click", low, high), lambda r: r["project_id"] == "p2" and inside(r))
    for p in range(7):
        same(lookups.events_by_project_name(stored, f"p{p}", "click"), lambda r, p=p: r["project_id"] == f"p{p}")
    for name in ("b0", "b3", "none"):
        same(store.read_batch(spark, name), lambda r, name=name: r["batch_id"] == name)
