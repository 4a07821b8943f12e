import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.llm import chat as C

_TEXT = st.lists(st.sampled_from([*C.CONTROL, "\\", "\n", "<", "s>", "a", "é", "[", "/"]), max_size=8).map("".join)


@settings(max_examples=300)
@given(st.lists(st.tuples(_TEXT, _TEXT), max_size=4))
def test_round_trip(turns):
    formatted = "".join(C.opening(r) + C.escape(x) + C.CLOSE for r, x in turns)
    assert C.parse(formatted) == turns
    assert all(c not in C.escape(x) for _, x in turns for c in C.CONTROL)


def test_every_reply_is_one_example(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "<s>\\"), (1, 2, "assistant", "[INST]"), (1, 3, "user", "u"),
             (1, 4, "assistant", ""), (1, 5, "user", "after"), (2, 0, "user", "alone"), (3, 0, "assistant", "first")]
    frame = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    rows = C.expand(frame).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.example, r.n_turns) for r in rows] == [(1, 0, 3), (1, 1, 5), (1, 2, 6), (2, 0, 1), (3, 0, 1)]
    assert [C.unescape(r.formatted[r.loss_start : r.loss_end]) for r in rows] == ["[INST]", "", "", "", "first"]
    for r in rows:  # all turns before the reply are its context
        assert C.parse(r.formatted) == [(t[2], t[3]) for t in turns if t[0] == r.conv_id][: r.n_turns]
    assert rows[0].formatted[rows[0].loss_end :] == C.CLOSE


def test_digests(spark):
    frame = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "é<s>"), (1, 2, "assistant", "b"), (None, 0, None, None)],
        "conv_id long, turn int, role string, text string",
    )
    rows = {r.conv_id: r for r in C.digests(C.expand(frame)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert rows[1].turns_sha256 == sha("user\nq\nassistant\né<s>\nassistant\nb\n")
    assert (rows[1].loss_chars, rows[1].loss_sha256, rows[1].n_turns) == (5, sha("é<s>b"), 3)
    assert (rows[None].turns_sha256, rows[None].loss_sha256) == (sha("\n\n"), sha(""))


def test_long_conversations_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(C, "BATCH_CHARS", 50)
    turns = [(c, t, ("user", "assistant")[t % 2], f"text {t}") for c in range(3) for t in range(60)]
    rows = C.digests(C.expand(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))).collect()
    assert [(r.n_turns, r.n_examples) for r in rows] == [(60, 30)] * 3
