"""Importance resampling against plain sums, sorts and counts."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.llm import importance
from batchloom.llm.importance import SignedPlanes, bucket_gains, bucket_numbers, resample, word_bytes

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@given(st.text(st.sampled_from("aZ09 ’é\x00\x7f😀_\x85 -"), max_size=40))
def test_words(text):
    assert [w.decode() for w in word_bytes(text)] == WORDS.findall(lower(text))


@settings(deadline=None)
@given(st.lists(st.integers(-(10**6), 10**6), min_size=1, max_size=90), st.integers(0, 2**40))
def test_planes_give_the_exact_sum(gains, top):
    rng = random.Random(top)
    counts = np.array([[rng.randrange(top + 1) if rng.random() < 0.2 else rng.randrange(3) for _ in gains] for _ in range(5)])
    assert SignedPlanes(gains).weights(counts) == [sum(int(c) * g for c, g in zip(row, gains)) for row in counts]


def test_features_of_several_lengths():
    words = "a b a b c".split()
    runs = [" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)]
    n, found, totals = bucket_numbers("A b, a-b C", 50, 2)
    assert n == 9 and dict(zip(found.tolist(), totals.tolist())) == Counter(crc32(r.encode()) % 50 for r in runs)


def brute(rows, target, buckets=importance.BUCKETS, least=20, per_cent=10):
    def features(text):
        return WORDS.findall(lower(text or ""))

    def bucket(word):
        return crc32(word.encode()) % buckets

    s = Counter(bucket(w) for _, t in rows for w in features(t))
    t = Counter(bucket(w) for x in target for w in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))

    out = []
    for key, text in rows:
        words = features(text)
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(w)) for w in words)
        out.append([key, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(may[: len(may) * per_cent // 100])}
    return Counter((*r, ranks.get(id(r))) for r in out)


def made_rows(n):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "don’t"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(n)]
    return rows + [(None, "x " * 30), (None, None), (7, ""), (7, rows[7][1]), *[(99, "same words " * 15)] * 40]


def test_against_brute_force(spark):
    rows, target = made_rows(200), ["w1 w2 w3 w4 Ärger", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, found.collect())) == brute(rows, target)


def test_empty_target_and_empty_table(spark):
    rows = made_rows(30)
    docs, nothing = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert Counter(map(tuple, resample(docs, nothing).collect())) == brute(rows, [])
    assert resample(docs.limit(0), nothing).collect() == []


def test_drawn_keeps_the_columns(spark):
    rows = [(i, f"w{i % 9} " * 25, "x") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, importance_rank string")
    found = importance.drawn(docs, spark.createDataFrame([("w3",)], "text string"))
    assert found.columns == [*docs.columns, "importance_rank_"] and found.count() == 5
    assert sorted(r.importance_rank_ for r in found.collect()) == [1, 2, 3, 4, 5]


def test_draw_follows_the_target(spark):
    """Documents that share the target's words are drawn first."""
    rows = [(i, ("alpha beta gamma " if i % 10 == 0 else "delta epsilon zeta ") * 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = resample(docs, spark.createDataFrame([("alpha beta gamma",)], "text string"))
    assert {r.doc_id for r in found.filter("rank IS NOT NULL").collect()} == set(range(0, 100, 10))
