"""Daily counts merged from epochs equal those of all events."""

from batchloom.operators.layout import DAY_MS
from batchloom.operators.lookups import daily_counts
from batchloom.sources import store as store_module
from batchloom.sources.store import EventStore
from batchloom.streaming.ingest import process_epoch
from helpers import batch, event, messages, scan_of


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_counts_after_replay_rewriting_and_a_crash(spark, tmp_path, monkeypatch, long_metadata):
    store = EventStore(str(tmp_path / "store")).create(spark)
    other = EventStore(store.root, "other")
    assert _rows(store.read_daily(spark)) == []

    def send(to, epoch, name):
        events = [event(timestamp=1 + i % 3 * DAY_MS + i, projectid=f"p{i % 2}", event=name) for i in range(9)]
        process_epoch(to, messages(spark, [batch(f"{name}{epoch % 2}", *events), "{"]), epoch)

    def same():
        assert _rows(store.read_daily(spark)) == _rows(daily_counts(store.read(spark, "events")))

    send(store, 0, "a")
    same()
    store.roll_up(spark)
    same()
    send(store, 1, "b")
    send(store, 1, "b")
    send(store, 2, "a")  # a copy of epoch 0
    send(other, 0, "c")
    same()
    with monkeypatch.context() as patch:  # written, and broken off before the marker
        patch.setattr(store_module.EventStore, "_mark", lambda *_: 1 / 0)
        try:
            store.roll_up(spark)
        except ZeroDivisionError:
            pass
    same()
    send(store, 3, "d")
    store.roll_up(spark)
    store.roll_up(spark)
    same()
    rows, scan, _ = scan_of(store.read_daily(spark), "daily")
    assert rows and "timestamp_ms" not in scan
    made = store.rewrite(spark, str(tmp_path / "made"))
    assert _rows(made.read_daily(spark)) == _rows(store.read_daily(spark))
    made.roll_up(spark)
    assert _rows(made.read_daily(spark)) == _rows(store.read_daily(spark))
