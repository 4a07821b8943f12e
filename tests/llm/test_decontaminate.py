import random

from samples import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.llm import decontaminate as D


def brute(items, text):
    words, hit, found = D.words_of(text), set(), set()
    for name, item in items:
        parts = D.words_of(item)
        n = min(10, len(parts))
        windows = {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if n and tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(name)
    return len(words), hit, sorted(found)


_TEXT = st.lists(st.sampled_from(["a", "b", "c", "é", "X1"]), max_size=40).map(" ".join)


@settings(max_examples=300)
@given(st.lists(_TEXT, max_size=4), _TEXT)
def test_same_as_all_windows(items, text):
    items = [(str(i), t) for i, t in enumerate(items)]
    n, spans, names = D.Fingerprints(items).find(text)
    assert (n, {p for a, b in spans for p in range(a, b)}, names) == brute(items, text)


def test_long_texts():
    draw = random.Random(5)
    item = [f"w{draw.randrange(50)}" for _ in range(300)]
    text = [f"w{draw.randrange(50)}" for _ in range(5000)] + item[40:52] + ["zz"] + item[100:109] + ["zz"] + item[7:200]
    items = [("x", " ".join(item)), ("y", " ".join(item[:9])), ("z", "w1")]
    n, spans, names = D.Fingerprints(items).find(" ".join(text))
    assert (n, {p for a, b in spans for p in range(a, b)}, names) == brute(items, " ".join(text))


def test_blocks_give_the_same(spark, docs_of, monkeypatch):
    docs = docs_of([(1, prose(1), "en", "a", 1), (2, prose(2) + " " + prose(1), "en", "a", 1), (3, prose(5), "en", "a", 1)])
    benchmark = spark.createDataFrame([(1, prose(1)), (2, prose(2)), (3, "w1x"), (4, None)], "item_id int, text string")
    whole = D.contamination(docs, benchmark)
    name = whole.columns[-1]
    assert name == "contamination_"  # there is a column Contamination

    def facts(frame):
        rows = frame.select("doc_id", f"{name}.*").collect()
        return {r.doc_id: (r.n_words, {p for s in r.spans for p in range(s.first, s.end)}, set(r["items"])) for r in rows}

    one = facts(whole)
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    assert facts(D.contamination(docs, benchmark)) == one
    assert one[2][2] == {"1", "2"} and one[3] == (80, set(), set())
    assert [r.doc_id for r in D.drop_contaminated(docs, benchmark).collect()] == [3]
