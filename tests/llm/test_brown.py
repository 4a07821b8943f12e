"""Class-based n-grams against a plain version of the same model, and what must hold of it."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from batchloom.llm import brown
from batchloom.llm.brown import _narrow, _wide, fit_and_score, held_out, op12_class_ngrams, tokens_of

END = None


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        low = low.replace(space, " ")
    return [w for w in low.split(" ") if w]


@given(st.text(st.sampled_from("aZé \t\n\x0b\x1c\x85  "), max_size=30))
def test_tokens(text):
    assert [w.decode() for w in tokens_of(text)] == split(text)


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_packing(numbers):
    assert _wide(_narrow(np.array(numbers, np.int64))).tolist() == numbers


def signed(data):
    h = xxhash.xxh64(data, seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def held(key):
    return crc32(("" if key is None else str(key)).encode()) % 10 == 0


def brute(rows, k, sweeps, least):
    """The whole model by dictionaries over plain lists of words."""
    learned = [split(t) for d, t in rows if not held(d)]
    count = Counter(w for words in learned for w in words)
    ends, n, v = len(learned), sum(count.values()) + len(learned), len(count) + bool(learned)
    n1, n2 = (sum(c == i for c in count.values()) for i in (1, 2))
    discount = min(max(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, 0.1), 0.9)

    def unit(word):
        if word is END:
            return signed(b"\xff\xff")
        data = word.encode()
        return signed(data if count[word] >= least else b"\xff" + data[-3:])

    total, types = Counter(), Counter()
    for w, c in count.items():
        total[unit(w)] += c
        types[unit(w)] += 1
    cls = {u: i + 1 for i, u in enumerate(sorted(total, key=lambda u: (-total[u], u))[: k - 1])}
    cls[unit(END)] = 0
    lines = [[unit(w) for w in [END, *words, END]] for words in learned]

    def neighbours():
        near = defaultdict(Counter)
        for line in lines:
            for a, b in zip(line, line[1:]):
                if a in cls:
                    near[b][cls[a]] += 1
                if b in cls:
                    near[a][k + cls[b]] += 1
        return near

    def best(near):
        pairs = np.zeros((k, k))
        for u, c in cls.items():
            for at, m in near[u].items():
                if at < k:
                    pairs[at, c] += m
        scores = brown.exchange_scores(pairs)
        return {u: int(np.round(sum(m * scores[at] for at, m in near[u].items()), 6)[1:].argmax()) + 1 for u in total if near[u]}

    near = neighbours()
    found = best(near)
    cls.update({u: found.get(u, u % (k - 1) + 1) for u in total if u not in cls})
    for sweep in range(sweeps):
        found = best(neighbours())
        cls.update({u: c for u, c in found.items() if u % brown.PARTS == sweep % brown.PARTS})
    in_class, kinds, pairs = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for u in total:
        in_class[cls[u]] += total[u]
        kinds[cls[u]] += types[u]
    in_class[0] = ends
    for line in lines:
        for a, b in zip(line, line[1:]):
            pairs[cls[a], cls[b]] += 1
    share = (in_class + 0.1) / (in_class.sum() + 0.1 * k)
    out = {}
    for d, text in rows:
        words = split(text)
        base = sum(math.log10(((count[w] if w else ends) + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, END])
        score, last = 0.0, 0
        for w in [*words, END]:
            c = cls.get(unit(w), int(kinds[1:].argmax()) + 1)
            score += math.log10((pairs[last, c] + 5 * share[c]) / (pairs[last].sum() + 5))
            if w is not END:
                inside = (count[w] - discount) if count[w] else discount * kinds[c]
                score += math.log10(inside / in_class[c]) if kinds[c] else 0.0
            last = c
        known = sum(count[w] > 0 for w in words) + (ends > 0)
        out[(d, text)] = (held(d), len(words) + 1, known, base if n else 0.0, score if n else base)
    return out, n


def made_rows(n):
    """Two languages of nouns, verbs and endings, so that classes help."""
    rng = random.Random(3)
    nouns = [[f"{a}n{i}" for i in range(30)] for a in "xy"]
    verbs = [[f"{a}v{i}ing" for i in range(12)] for a in "xy"]
    rows = []
    for i in range(n):
        a = i % 2
        words = []
        for _ in range(rng.randrange(1, 25)):
            words += [("the", "la")[a], rng.choice(nouns[a]), rng.choice(verbs[a]), f"rare{rng.randrange(400)}"]
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (None, "The xn1 unseenx"), (n + 3, "xn1 neverqq " * 3), (7, rows[7][1])]


@pytest.mark.parametrize("chunk", [400, 1 << 20])
def test_against_brute_force(spark, chunk):
    rows = made_rows(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, model = fit_and_score(docs, held_out(docs.doc_id), classes=6, sweeps=2, least_count=4, chunk_bytes=chunk)
    want, n = brute(rows, 6, 2, 4)
    assert model.totals.tokens == n
    texts = dict(rows)
    found = found.collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    for r in found:
        flag, n_tokens, known, base, score = want[(r.doc_id, texts[r.doc_id])]
        assert (r.held_out, r.n_tokens, r.n_known) == (flag, n_tokens, known)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, abs=1e-6)


def test_chances_add_up(spark):
    """After every class, all words known and unknown have together the chance one."""
    rows = made_rows(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, model = fit_and_score(docs, held_out(docs.doc_id), classes=5, least_count=3)
    steps, d = 10 ** model.steps(), model.totals.discount
    assert np.allclose(steps.sum(axis=1), 1)
    inside = [(n - d * t) / n + 10**u for n, t, u in zip(model.counts[1:], model.types[1:], model.unseen()[1:]) if n]
    assert np.allclose(inside, 1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    found, model = fit_and_score(docs, held_out(docs.doc_id))
    assert model.totals.tokens == 0
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in found.collect()) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def test_held_out_texts_are_likelier_by_class(spark):
    rows = op12_class_ngrams(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.3
    assert len(rows) > 50
