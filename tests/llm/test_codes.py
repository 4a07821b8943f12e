"""Product codes with bounds against plain integer k-means."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.llm import codes
from batchloom.llm.codes import Bounds, Codebooks, assign, coded, train_codes


def plain(rows, parts=4, entries=256, rounds=4):
    """``{(key, code, error, label_error, digest): times}`` by loops over Python integers."""
    kept = []
    for key, vector, label in rows:
        if vector and not any(x is None or not math.isfinite(x) for x in vector):
            kept.append((key, tuple(math.floor(1024 * x) for x in vector), label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def distance(x, y):
        return sum((a - b) ** 2 for a, b in zip(x, y))

    def nearest():
        return [[min(range(len(books[p])), key=lambda e: (distance(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        chosen = nearest()
        for p in range(parts):
            members = {}
            for c, e in zip(cut, chosen):
                members.setdefault(e[p], []).append(c[p])
            for e, xs in members.items():
                books[p][e] = tuple(sum(column) // len(xs) for column in zip(*xs))
    chosen = nearest()
    errors = [sum(distance(c[p], books[p][e[p]]) for p in range(parts)) for c, e in zip(cut, chosen)]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter(
        (key, "".join(f"{e:02x}" for e in chosen[i]), errors[i], by_label[label], digest) for i, (key, _, label) in enumerate(kept)
    )


def made_rows(n, dim=8, spread=6):
    rng = random.Random(n)
    centers = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(spread)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(5, rows[9][1], 0), (5, rows[9][1], 0), (None, rows[3][1], 1), (2, None, 1), (3, [None] * dim, 1)]
    return rows + [(-i, [0.25] * dim, 2) for i in range(5)]


@pytest.mark.parametrize("n, entries", [(120, 12), (40, 256), (400, 70)])
def test_against_plain_k_means(spark, n, entries):
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in made_rows(n)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = coded(frame, entries=entries)
    assert Counter(map(tuple, found.collect())) == plain(rows, entries=entries)


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 90), st.integers(1, 100), st.integers(0, 10**6))
def test_bounds_hold_and_nothing_is_missed(k, n, seed):
    """After each move of the entries every bound holds, and codes are those of a full search."""
    rng = np.random.default_rng(seed)
    x, history = rng.integers(-40, 40, (n, 3)).astype(float), [rng.integers(-40, 40, (1, k, 3))]
    state = Bounds.none(n, -(-k // codes.GROUP))
    for _ in range(5):
        books = Codebooks(history)
        entries, moved = books.last[0].astype(float), books.displacements()[:, 0]
        assign(x, entries, moved, state)
        # Through the stored form, where bounds are four-byte floats.
        packed = codes._pack([state])
        batch = codes.pa.RecordBatch.from_arrays([codes.pa.array(b, codes.pa.binary()) for b in packed], ["codes", "bounds", "stamps"])
        state = codes._unpack(batch, 1, state.lower.shape[1])[0]
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert state.code.tolist() == full.argmin(axis=1).tolist()
        distance = np.sqrt(full)
        upper = state.upper + moved[state.upper_at, state.code]
        assert (upper * (1 + 1e-6) + 1e-6 >= distance[np.arange(n), state.code]).all()
        distance[np.arange(n), state.code] = np.inf
        for g in range(state.lower.shape[1]):
            inside = slice(g * codes.GROUP, (g + 1) * codes.GROUP)
            lower = state.lower[:, g] - moved[state.lower_at[:, g], inside].max(axis=1)
            assert (lower * (1 - 1e-6) - 1e-6 <= distance[:, inside].min(axis=1)).all()
        history = [*history, history[-1] + rng.integers(-6, 7, (1, k, 3)) * (rng.random((1, k, 1)) < 0.5)]


def test_later_rounds_measure_less():
    """Rounds in which entries hardly move need few distances, and moving there and back costs nothing."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-1000, 1000, (64, 4))
    x = (centers[rng.integers(0, 64, 2000)] + rng.integers(-9, 9, (2000, 4))).astype(float)
    state, history = Bounds.none(2000, 2), []
    measured = []
    for move in (0, 30, 0, 0):
        history.append(centers[None] + move)
        books = Codebooks(history)
        _, n = assign(x, books.last[0].astype(float), books.displacements()[:, 0], state)
        measured.append(n)
    assert measured[0] == 2000 * 65 and measured[1] < measured[0] / 2 and measured[3] == 0


def test_other_lengths_and_sizes(spark):
    frame = spark.createDataFrame(
        [(1, [0.5, 0.25, 1.0, -1.0, 2.0], 1), (2, [0.5], 1), (3, [0.0] * 5, 1)], "vec_id long, embedding array<float>, label int"
    )
    found = {r.vec_id: (r.code, r.error) for r in coded(frame).collect()}
    assert found == {1: ("00000000", 0), 3: ("01010100", 0)}  # the last part is zeros in both: the smaller index
    with pytest.raises(ValueError):
        train_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], frame.schema))
    assert coded(frame.limit(0)).collect() == []
