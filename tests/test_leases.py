"""Leases against a walk over each message's log."""

import random
from collections import Counter

from batchloom.operators.leases import claimable_at, lease_timeline

SCHEMA = "message_id string, consumer string, kind string, at_ms long"


def walked(rows, idle):
    out = []
    by_message = {}
    for m, c, k, at in rows:
        if m is not None and at is not None and k in ("delivered", "acknowledged"):
            by_message.setdefault(m, []).append((at, k == "acknowledged", c is None, c or "", c))
    for m, log in by_message.items():
        log.sort()
        for i, (at, ack, _, _, consumer) in enumerate(log):
            if ack:
                continue
            next_ack = next((x[0] for x in log[i + 1 :] if x[1]), None)
            next_delivery = next((x[0] for x in log[i + 1 :] if not x[1]), None)
            by_ack = next_ack is not None and (next_delivery is None or next_ack <= next_delivery)
            ended = next_ack if by_ack else next_delivery
            by = "acknowledged" if by_ack else "claimed" if next_delivery is not None else None
            claimable = at + idle if ended is None or ended >= at + idle else None
            out.append((m, consumer, at, ended, by, claimable, by == "claimed" and next_delivery < at + idle))
    return out


def test_ties_and_missing_rows(spark):
    rows = [
        ("a", "w1", "delivered", 0), ("a", "w2", "delivered", 60_000), ("a", "w2", "acknowledged", 60_000),
        ("b", "w1", "acknowledged", 5), ("b", "w1", "delivered", 10), ("b", "w2", "delivered", 59_999), ("b", "w2", "delivered", 59_999),
        ("c", None, "delivered", 10), ("c", "w1", "acknowledged", 20), ("c", "w1", "acknowledged", 30), ("c", "w3", "delivered", 40),
        (None, "w", "delivered", 1), ("d", "w", "delivered", None), ("d", "w", "else", 1), ("d", "w", None, 1),
        ("e", "w1", "delivered", -5), ("e", "w1", "delivered", -5),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = lease_timeline(frame)
    assert Counter(map(tuple, found.collect())) == Counter(walked(rows, 60_000))
    first = {(r.message_id, r.delivered_ms): r for r in found.collect()}
    assert (first["a", 0].ended_by, first["a", 0].ended_ms, first["a", 0].claimable_ms) == ("acknowledged", 60_000, 60_000)
    assert first["a", 60_000].ended_by == "acknowledged" and first["b", 10].early and first["c", 40].ended_by is None
    assert sorted(r.message_id for r in claimable_at(found, 60_040).collect()) == ["c", "e"]
    assert lease_timeline(frame.limit(0)).isEmpty()


def test_one_message_with_most_rows(spark):
    """Slices change nothing: leases reach over empty ones and over many."""
    rng = random.Random(2)
    rows = [("hot", f"w{rng.randrange(9)}", "acknowledged" if rng.random() < 0.1 else "delivered", rng.randrange(10**7)) for _ in range(1_500)]
    rows += [(f"m{rng.randrange(40)}", f"w{i % 5}", "acknowledged" if rng.random() < 0.3 else "delivered", rng.randrange(10**7)) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = Counter(walked(rows, 1_000))
    for slice_ms in (10**9, 50_000, 777):
        assert Counter(map(tuple, lease_timeline(frame, 1_000, slice_ms).collect())) == want
