import random

import numpy as np
from samples import prose

from batchloom.llm import quality as Q


def _docs(n, seed=1):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, draw.randint(60, 200)).split()
        bad = i % 4 == 0
        text = [" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "%%" for w in words)][i % 3] if bad else " ".join(words)
        rows.append((i, text, draw.choice(["en", "de"]), f"s{i % 5}", len(text)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = _docs(600)
    seen = spark.createDataFrame([x for x in labels if x[0] < 300], "doc_id long, quality int")
    found = Q.scored(docs_of(rows), Q.train(docs_of(rows), seen)).select("doc_id", "quality_.*").collect()
    right = [r.kept == (r.doc_id % 4 != 0) for r in found if r.doc_id >= 300]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= x <= 1 for r in found for x in (r.score, r.content, r.meta))


def test_sample_is_bounded(spark, docs_of):
    rows, labels = _docs(60)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.train(docs_of(rows), frame, labelled=40, pool=0)
    assert model.constant is None


def test_views_teach_each_other():
    """With few labels, the pool's pseudo-labels make the weaker view better than labels alone do."""
    right = {0: [], 4: []}
    for seed in range(6):
        draw = np.random.default_rng(seed)
        y = draw.integers(0, 2, 2000).astype(float)
        strong = (y * 6 - 3)[:, None] + draw.normal(size=(2000, 3))
        weak = (y * 1.2 - 0.6)[:, None] + draw.normal(size=(2000, 12))
        labels = np.where(np.arange(2000) < 12, y, np.nan)
        for rounds, share in right.items():
            model = Q.co_train([strong, weak], labels, np.arange(2000) % 4 == 0, rounds)
            share.append(((model.view_logits([strong, weak])[:, 1] > 0) == (y == 1))[12:].mean())
    assert np.mean(right[4]) > np.mean(right[0]) + 0.01


def test_without_labels_everything_stays(spark, docs_of):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows, _ = _docs(8)
    assert Q.keep_good(docs_of(rows), none).count() == 8
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert Q.keep_good(docs_of(rows), one).count() == 8


def test_one_row_of_a_key_is_fitted(spark, docs_of, monkeypatch):
    """A key with very many rows counts once, and only one of its rows reaches the driver."""
    rows, labels = _docs(60)
    many = [(0, *r[1:]) for r in _docs(300, seed=2)[0]]
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "co_train", lambda views, y, held: seen.append((len(y), views[0].tobytes())))
    for order in (1, -1):
        Q.train(docs_of((rows + many)[::order]), frame)
    assert [n for n, _ in seen] == [60, 60] and seen[0] == seen[1]


def test_default_sample(spark, docs_of, monkeypatch):
    """As many rows as before they were lowered: 16,000 with a label, 8,000 without."""
    rows = [(i, f"w{i}", "en", "a", 1) for i in range(25_000)]
    frame = spark.range(16_500).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    monkeypatch.setattr(Q, "co_train", lambda views, y, held: (int((~np.isnan(y)).sum()), int(np.isnan(y).sum())))
    assert Q.train(docs_of(rows), frame) == (16_000, 8_000)
