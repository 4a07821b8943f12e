import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.llm import rules as R


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "#", "é", "\xa0", "\r", "\x1c", "|"]), max_size=60).map("".join))
def test_facts(text):
    f = R.Facts(text)
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute(text)


def test_order_does_not_change_the_verdict(spark, docs_of):
    from samples import EDGE_ROWS

    docs = docs_of([*EDGE_ROWS, (50, "MANY!! LOUD!! WORDS!! " * 5 + " ".join(f"x{i}" for i in range(60)), "en", "a", 1)])
    name = "rules_"
    ways = [R.cascade(docs, order).select("doc_id", f"{name}.*").collect() for order in (R.RULES, R.RULES[::-1])]
    assert sorted(map(str, ways[0])) == sorted(map(str, ways[1]))
    assert all(r.base_failed and not r.kept for r in ways[0] if r.doc_id in (3, 4, 5))


def test_costly_rules_come_late(spark, docs_of):
    import time

    rules = [R.Rule("slow", lambda f: time.sleep(0.002) or True), R.Rule("never", lambda f: False), R.Rule("fast", lambda f: True)]
    docs = docs_of([(i, "text", "en", "a", 1) for i in range(20)])
    assert R.measured_order(docs, rules) == [2, 0, 1]
    assert R.measured_order(docs.limit(0), rules) == [0, 1, 2]


def test_junk_goes_and_prose_stays():
    from samples import prose

    judge = lambda text: not R.Facts(text).base_failed and not any(r.rejects(R.Facts(text)) for r in R.RULES)
    good = prose(3, 120).replace("x", "ing").replace("w", "th")
    assert judge(good)
    words = good.split()
    assert not judge(" | ".join(words)) and not judge(" ".join(w.upper() + "!!" for w in words))
    assert not judge(" ".join(w + "###" for w in words)) and not judge("same line of words here\n" * 30)
