import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.llm import mixing as M


@settings(max_examples=100)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 50)), max_size=60), st.integers(0, 9))
def test_flight_keeps_both_totals(units, seed):
    p, size = [x for x, _ in units], [float(s) for _, s in units]
    tokens, count = sum(x * s for x, s in zip(p, size)), sum(p)
    q = M.flight(list(p), size, random.Random(seed).random)
    assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
    assert abs(sum(x * s for x, s in zip(q, size)) - tokens) < 1e-4 and abs(sum(q) - count) < 1e-4
    assert all(x in (0.0, 1.0) for x in M.land(q, size))


def test_flight_keeps_probabilities():
    size, p, times = [5.0, 9.0, 2.0, 30.0, 7.0, 7.0], [0.2, 0.5, 0.7, 0.4, 0.3, 0.9], 4000
    total = [0.0] * 6
    for seed in range(times):
        q = M.flight(list(p), size, random.Random(seed).random)
        total = [t + x for t, x in zip(total, q)]
    assert all(abs(t / times - x) < 0.03 for t, x in zip(total, p))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return {**fixed, **share}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 1000, "é": 7, None: 40, "Z": 3}, {"a": 0, "b": 0}, {"x": 5}, {None: 0, "a": 9, "b": 400, "c": 1},
])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in M.targets(rows).collect()}
    wanted = brute_targets(sizes)
    assert set(found) == set(wanted) and all(found[s] == pytest.approx(wanted[s]) for s in wanted)


def test_mix_meets_its_targets(spark):
    draw = random.Random(2)
    rows = [(i, draw.randint(0, 400), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    rows += [(9999, 50, "a")] * 600  # one row many times
    frame = spark.createDataFrame(rows, "doc_id long, size long, source string")
    taken = M.mix(frame, ["doc_id"], block=200)
    found = taken.collect()
    assert len(found) == len(rows)
    for source in {s for _, _, s in rows}:
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 25
        expected = mine[0].target / mine[0].source_size * len(mine)
        assert abs(sum(r.copies for r in mine) - expected) <= 0.02 * len(mine) + 16
        assert all(0 <= r.copies <= 3 for r in mine)
    again = M.mix(frame.repartition(13, "size"), ["doc_id"], block=200).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_resample_repeats_rows(spark, docs_of):
    rows = [(i, "x " * (1 + i % 30), "en", "ab"[i % 2], 1) for i in range(200)] + [(7, "same row", "en", "a", 1)] * 30
    docs = docs_of(rows)
    out = M.resample(docs)
    assert out.columns == docs.columns
    words = {s: sum(len(r.text.split()) for r in out.collect() if r.source == s) for s in "ab"}
    total = sum(len(r[1].split()) for r in rows)
    assert abs(words["a"] - total * 5 / 7) <= 25 and abs(words["b"] - total * 2 / 7) <= 25


def test_words():
    assert "\\x09" in M.WORD  # tabs to carriage returns, not other white space
