"""Quality rules as a short-circuit cascade.

Each rule looks at the facts of one text, which are worked out when first asked for. A small sample is measured on the
executors: what each rule costs alone and how much it rejects. Rules then run in order of rejections per cost, and a
text that one rule rejects sees no further rule. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from batchloom.llm.common import WORD, free_name, named, table

#: Rows that the estimate of cost and selectivity reads, at most.
SAMPLE = 600
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


class Facts:
    """Counts of one text, each worked out once, when needed. A null text is an empty one."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII spaces only

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def _lines(self) -> Counter[str]:
        return Counter(x for x in self.text.split("\n") if x.strip(_SPACES))

    @property
    def n_lines(self) -> int:
        return self._lines.total()

    @property
    def n_dup_lines(self) -> int:
        return self.n_lines - len(self._lines)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, n)
        kinds = len(numbers)
        pairs = ids[:-1] * kinds + ids[1:]
        if kinds >= 1 << 20:  # keep the next product within 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * kinds + ids[2:]
        _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[which] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= again
        return int(covered.sum())

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def n_capitals(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_bare_words(self) -> int:
        """Words of ASCII punctuation and digits only."""
        return sum(not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789") for w in self.words)

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count("!!")

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


RULES = [
    Rule("many symbols", lambda f: 5 * f.n_symbols > f.n_words),
    Rule("word length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
    Rule("words without letters", lambda f: 4 * f.n_bare_words > f.n_words),
    Rule("shouting", lambda f: 5 * f.n_shouts > f.n_words),
    Rule("capitals", lambda f: 2 * f.n_capitals > f.n_letters),
    Rule("repeated lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
]


def measured_order(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> list[int]:
    """Places of ``rules`` by rejections per cost, highest first, estimated on at most ``sample`` rows."""

    @arrow_udf("array<struct<rule:int,ns:long,rejected:int>>")
    def trials(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("rule", pa.int32()), ("ns", pa.int64()), ("rejected", pa.int32())]))
        for texts in batches:
            rows = []
            for t in texts:
                row = []
                for i, rule in enumerate(rules):
                    facts, begun = Facts(t.as_py()), time.perf_counter_ns()
                    rejected = bool(rule.rejects(facts))
                    row.append({"rule": i, "ns": time.perf_counter_ns() - begun, "rejected": int(rejected)})
                rows.append(row)
            yield pa.array(rows, kind)

    tried = docs.select(named(text).alias("t")).limit(sample).select(F.explode(trials("t")).alias("x")).select("x.*")
    found = tried.groupBy("rule").agg(F.avg("ns").alias("ns"), F.avg("rejected").alias("rejected")).collect()
    rate = {r.rule: (r.rejected + 1e-6) / max(1.0, r.ns) for r in found}
    return sorted(range(len(rules)), key=lambda i: (-rate.get(i, 0.0), i))


def cascade(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``rules``: the base facts, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rule fails or any of ``rules`` rejects. A text without words fails the base rule.
    """
    order = [rules[i] for i in measured_order(docs, rules, text)]
    facts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @arrow_udf("struct<" + ",".join(f"{f}:long" for f in facts) + ",base_failed:boolean,kept:boolean>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([*((f, pa.int64()) for f in facts), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
        for texts in batches:
            rows = []
            for t in texts:
                seen = Facts(t.as_py())
                row = {f: getattr(seen, f) for f in facts}
                failed = seen.base_failed
                row |= {"base_failed": failed, "kept": not failed and not any(r.rejects(seen) for r in order)}
                rows.append(row)
            yield pa.array(rows, kind)

    return docs.withColumn(free_name(docs, "rules"), judge.asNondeterministic()(named(text)))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return cascade(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*")


_ALPHA = "regexp_replace(t, '[^\\p{L}]', '', 'g')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
win AS (
  SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
f AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[^!-@\\x5B-`{{-~]'))) AS bare,
    (length(t) - length(replace(t, '!!', ''))) / 2 AS shouts,
    length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS capitals, length({_ALPHA}) AS letters
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)
),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 4 * bare > n_words OR 5 * shouts > n_words OR 2 * capitals > letters OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""
