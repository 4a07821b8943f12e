import random
import zlib

from batchloom.llm import toxicity as X


def _docs(n):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randint(20, 120))]
        toxic = draw.random() < 0.25
        for _ in range(draw.randint(1, 3) if toxic else 0):
            words[draw.randrange(len(words))] = draw.choice(["grumpf", "vileword", "stemmo" + draw.choice("abcdef")])
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def _held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_ranking(spark, docs_of):
    rows, labels = _docs(900)
    rows += [(5000, "you are a gr0mpf gr.u.m.p.f", "en", "a", 1), (5001, "g r u m p f " + rows[0][1], "en", "a", 1), (5002, None, "en", "a", 1), (5003, "", "en", "a", 1)]
    seen = spark.createDataFrame([x for x in labels if not _held(x[0])], "doc_id long, toxic int")
    model = X.train(docs_of(rows), seen)
    assert "grumpf" in model.lexicon and any(t.startswith("stem") and t.endswith("*") for t in model.lexicon)
    columns = [c for c in X.scored(docs_of(rows), model).columns][-2:]
    assert columns == ["score_", "predicted_"]
    found = {r.doc_id: (r.score_, r.predicted_) for r in X.scored(docs_of(rows), model).collect()}
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for s, p in found.values())
    held = [(found[i][0], t) for i, t in labels if _held(i)]
    pairs = [(a > b) + 0.5 * (a == b) for a, t in held if t for b, u in held if not u]
    assert sum(pairs) / len(pairs) > 0.95
    assert found[5002] == found[5003] and found[5002][0] < 0.5


def test_features():
    maker = X.Featurizer({"grumpf": 3.0, "stem*": 2.0})
    value = lambda text, name: maker.features(text)[X.FEATURES.index(name)]
    assert value("Grumpf, stemmo ok", "log hits") > value("grumpf ok ok", "log hits") > 0
    assert value("gru.mpf ok", "disguised hits") == 1 and value("g r u m p f", "disguised hits") == 1
    assert value("you grumpf", "hits that address") == 1 and value("grumpf " + "x " * 20 + "you", "hits that address") == 0
    assert value("SHOUT ok", "shouted words") == 0.5
    assert not maker.features(None).any() and not maker.features(" \n").any()


def test_the_sample_is_bounded_in_rows(spark, docs_of):
    """One key holds most rows, some of them copies; it counts once, whatever the order of rows."""
    rows = [(7, f"text {i % 900}", "en", "a", 1) for i in range(2_500)] + [(i, f"w{i}", "en", "a", 1) for i in range(8, 300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    found = X.sample_of(docs_of(rows), labels, "doc_id", "toxic", 100).collect()
    assert len(found) == len({r["_key"] for r in found}) == 100
    again = X.sample_of(docs_of(rows[::-1]).repartition(7), labels, "doc_id", "toxic", 100).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    assert X.sample_of(docs_of(rows), labels, "doc_id", "toxic", 10_000).count() == 293


def test_constant_without_both_labels(spark, docs_of):
    rows, _ = _docs(5)
    none = X.train(docs_of(rows), spark.createDataFrame([], "doc_id long, toxic int"))
    ones = X.train(docs_of(rows), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r.score_ for r in X.scored(docs_of(rows), none).collect()} == {0.0}
    assert {r.predicted_ for r in X.scored(docs_of(rows), ones).collect()} == {1}
