"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and the reply, the only part under
the loss mask. What follows the last reply (or a conversation without one) becomes an example without a target, so no
turn is lost. A turn is written as ``<s>role``, a line end, the text, ``</s>``. Control strings inside roles and texts
get a backslash after their first character, and backslashes are doubled, which can be undone exactly.

Turns of a conversation meet by a shuffle on its id and are sorted there; a task then streams over them and holds the
text of one conversation, not a list of rows. The output of a conversation grows with the square of its length: that is
what the expansion means.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import materialize, named, table

# The control strings of the template and of a common one like it.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
OPEN, CLOSE = "<s>", "</s>"
ASSISTANT = "assistant"
#: Characters of one output batch.
BATCH_CHARS = 8 << 20

_GUARD = re.compile("|".join([r"\\", *(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)]))
_UNGUARD = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>", re.S)


def escape(text: str) -> str:
    """``text`` without a control string: a backslash after the first character of each; backslashes are doubled."""
    return _GUARD.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"\1", text)


def opening(role: str) -> str:
    return OPEN + escape(role).replace("\n", "\\\n") + "\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_EXAMPLE = "conv_id {0}, example long, n_turns long, formatted string, loss_start long, loss_end long"


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, example, n_turns, formatted, loss_start, loss_end``: one row per assistant turn, and one for the rest.

    The loss mask is ``[loss_start, loss_end)`` in code points of ``formatted`` and covers the escaped reply; it is
    empty in an example without a target. Null roles and texts are empty; a null ``conv_id`` is a conversation of its
    own. Equal turn numbers are ordered by role and text, a null number comes last.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema[conv].dataType
    arrow = to_arrow_type(kind)
    rows = turns.select(
        named(conv).alias("c"), named(turn).alias("t"), F.coalesce(named(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(named(text), F.lit("")).alias("x"),
    )
    ordered = rows.repartition("c").sortWithinPartitions("c", F.col("t").asc_nulls_last(), "r", "x")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key, prefix, number, n, open_ = 0, object(), "", 0, 0, False
        schema = pa.schema([
            ("conv_id", arrow), ("example", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
            ("loss_start", pa.int64()), ("loss_end", pa.int64()),
        ])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("c", "r", "x")]
            for c, r, x in zip(*columns):
                if c != key:
                    if open_:
                        held.append((key, number, n, prefix, len(prefix), len(prefix)))
                    key, prefix, number, n, open_ = c, "", 0, 0, False
                head, body = opening(r), escape(x)
                start = len(prefix) + len(head)
                prefix, n, open_ = prefix + head + body + CLOSE, n + 1, True
                if r == ASSISTANT:
                    held.append((key, number, n, prefix, start, start + len(body)))
                    number, open_, size = number + 1, False, size + len(prefix)
                if size >= BATCH_CHARS:
                    yield out()
                    held, size = [], 0
        if open_:
            held.append((key, number, n, prefix, len(prefix), len(prefix)))
        if held:
            yield out()

    return ordered.select("c", "r", "x").mapInArrow(examples, _EXAMPLE.format(kind.simpleString()))


_DIGEST = (
    "conv_id {0}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_examples long"
)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its formatted examples hold, parsed from them: turns from the longest, loss from each.

    ``formatted_chars`` counts the code points of all its examples. Every example is parsed where it lies; only its
    reply and digest are shuffled, so what moves grows with the conversations and not with their expansion.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = examples.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, hashes, replies, chars = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_end")]
            for text, a, b in zip(*columns):
                found, whole = parse(text), hashlib.sha256()
                for r, x in found:
                    whole.update(f"{r}\n{x}\n".encode("utf-8", "surrogatepass"))
                turns.append(len(found))
                hashes.append(whole.hexdigest())
                replies.append(unescape(text[a:b]))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("example"), pa.array(turns, pa.int64()), pa.array(hashes, pa.string()),
                 pa.array(replies, pa.string()), pa.array(chars, pa.int64())],
                ["conv_id", "example", "turns", "sha", "reply", "chars"],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        schema = pa.schema([
            ("conv_id", arrow), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()),
        ])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        begun, key, longest, loss, chars, formatted, n = False, None, (0, ""), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turns", "sha", "reply", "chars")]
            for c, turns, sha, reply, size in zip(*columns):
                if begun and c != key:
                    done.append((key, *longest, chars, loss.hexdigest(), formatted, n))
                    loss, chars, formatted, n = hashlib.sha256(), 0, 0, 0
                begun, key, longest, formatted, n = True, c, (turns, sha), formatted + size, n + 1
                loss.update(reply.encode("utf-8", "surrogatepass"))
                chars += len(reply)
            if len(done) >= 4096:
                yield out()
                done.clear()
        if begun:
            done.append((key, *longest, chars, loss.hexdigest(), formatted, n))
            yield out()

    name = kind.simpleString()
    each = examples.select("conv_id", "example", "formatted", "loss_start", "loss_end").mapInArrow(
        parsed, f"conv_id {name}, example long, turns long, sha string, reply string, chars long"
    )
    ordered = each.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.mapInArrow(read, _DIGEST.format(name))


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the formatted examples of every conversation, and of one that quotes control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digests(materialize(expand(turns.unionByName(quoting)), "examples"))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
f AS (
  SELECT *, '<s>' || role || chr(10) || regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'),
    '(<)(/?s>|<SYS>>|</SYS>>|\|)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') || '</s>' AS formatted
  FROM t
),
p AS (
  SELECT *, sum(length(formatted)) OVER w AS prefix, lead(turn) OVER w IS NULL AS last FROM f
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(prefix) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR last)::BIGINT AS n_examples
FROM p GROUP BY conv_id
"""
