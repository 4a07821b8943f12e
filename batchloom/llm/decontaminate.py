"""Benchmark decontamination by winnowing.

Training and test texts are reduced to fingerprints: of every window of ``w`` consecutive k-gram hashes the smallest
is kept. A shared span of ``k + w - 1`` words holds a whole window, so both sides keep the same hash of it: with
``k = 5`` and ``w = 6`` no shared span of ten words is missed. Items of fewer words are whole windows themselves and
are winnowed with a smaller ``w`` (or ``k``), so that the guarantee holds for their length. Fingerprints of both sides
are joined on the hash, and each hit is extended to both sides word by word, which also discards hash collisions.

The test set is the broadcast side. It is read in blocks of bounded size, one pass over the training rows per block,
so a test set of any size works; only a block is ever in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from batchloom.llm.common import free_name, materialize, named, table

SPAN = 10
GRAM = 5
#: Characters of benchmark text and items that one pass over the documents takes.
BLOCK_CHARS = 8 << 20
BLOCK_ITEMS = 100_000
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    """Words after lower-casing A-Z only."""
    return WORDS.findall((text or "").translate(UPPER))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word ids."""
    n = len(ids) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _FACTOR + ids[i : i + n].astype(np.uint64)
    out = (out ^ (out >> np.uint64(29))) * _ODD
    return out ^ (out >> np.uint64(32))


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every ``w`` consecutive ones, the rightmost of equals."""
    n = len(hashes) - w + 1
    if n < 1:
        return np.empty(0, np.int64)
    best, at, span = hashes, np.arange(len(hashes)), 1
    while span < w:  # windows of twice the length, the last ones overlapping
        step = min(span, w - span)
        lower = best[step:] <= best[:-step]
        best, at = np.where(lower, best[step:], best[:-step]), np.where(lower, at[step:], at[:-step])
        span += step
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


class Fingerprints:
    """The winnowed fingerprints of a block of test items, and the words to extend a hit with."""

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, gram: int = GRAM):
        self.span, self.vocabulary = span, {}
        same: dict[tuple[int, ...], list[str]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if words:  # item texts with the same words are one sequence with several names
                same[tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)].append(item)
        self.sequences = [np.array(s, np.int64) for s in same]
        self.names = [sorted(set(v)) for v in same.values()]
        self.needs = [min(len(s), span) for s in self.sequences]
        self.grams: dict[tuple[int, int], tuple] = {}
        for need in sorted(set(self.needs)):
            k = min(gram, need)
            self.grams[need] = (k, need - k + 1, *self._index(need, k, need - k + 1))

    def _index(self, need: int, k: int, w: int):
        hashes, places = [], []
        for s, sequence in enumerate(self.sequences):
            if self.needs[s] == need:
                grams = gram_hashes(sequence, k)
                for at in winnow(grams, w).tolist():
                    hashes.append(grams[at])
                    places.append((s, at))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        return np.array(hashes, np.uint64)[order], [places[i] for i in order]

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, spans of hit words (merged, end exclusive) and names of the items that occur."""
        words = words_of(text)
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        spans, found = [], set()
        if not self._may_match(ids):
            return len(words), [], []
        for need, (k, w, index, places) in self.grams.items():
            grams = gram_hashes(ids, k)
            kept = winnow(grams, w)
            low, high = np.searchsorted(index, grams[kept], "left"), np.searchsorted(index, grams[kept], "right")
            done: dict[tuple[int, int], int] = {}
            for i in np.flatnonzero(high > low).tolist():
                p = int(kept[i])
                for s, q in places[low[i] : high[i]]:
                    if done.get((s, p - q), -1) >= p:
                        continue  # inside a run that was extended already
                    a, b = self._extend(ids, self.sequences[s], p, q, k)
                    done[(s, p - q)] = max(b - k, p)
                    if b - a >= need:
                        spans.append((a, b))
                        found.add(s)
        return len(words), _merged(spans), sorted({n for s in found for n in self.names[s]})

    def _may_match(self, ids: np.ndarray) -> bool:
        """False when no run of known words is as long as the shortest need."""
        if not self.grams or not len(ids):
            return False
        gaps = np.flatnonzero(np.concatenate([[True], ids == 0, [True]]))
        return int(np.diff(gaps).max()) - 1 >= min(self.grams)

    @staticmethod
    def _extend(ids: np.ndarray, item: np.ndarray, p: int, q: int, k: int) -> tuple[int, int]:
        """The longest equal run on the diagonal of a hit; empty when the words of the k-gram differ."""
        if not np.array_equal(ids[p : p + k], item[q : q + k]):
            return p, p
        back = min(p, q)
        differs = np.flatnonzero(ids[p - back : p] != item[q - back : q])
        a = p - back + int(differs[-1]) + 1 if len(differs) else p - back
        ahead = min(len(ids) - p, len(item) - q)
        differs = np.flatnonzero(ids[p : p + ahead] != item[q : q + ahead])
        return a, p + (int(differs[0]) if len(differs) else ahead)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """Blocks of (item id as text, text), each of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(named(item).cast("string"), F.lit("")).alias("i"), named(text).alias("t"))
    for row in rows.toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t or "")
        if size >= BLOCK_CHARS or len(block) >= BLOCK_ITEMS:
            yield block
            block, size = [], 0
    if block:
        yield block


HITS = "struct<n_words:long,spans:array<struct<first:long,end:long>>,items:array<string>>"


def find_items(text: Column, block: list[tuple[str, str | None]]) -> Column:
    """Words, hit spans and items of one block of test items, as a struct column; the block goes to every task."""
    test = Fingerprints(block)
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ])

    @arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for t in texts:
                n, spans, items = test.find(t.as_py())
                found.append({"n_words": n, "spans": [{"first": a, "end": b} for a, b in spans], "items": items})
            yield pa.array(found, kind)

    return find.asNondeterministic()(text)


SUMMARY = "struct<n_hit:long,n_items:long,items_sha256:string>"


def _summary(spans: pa.Array, items: pa.Array) -> pa.Array:
    out = []
    for s, i in zip(spans.to_pylist(), items.to_pylist()):
        merged = _merged([(x["first"], x["end"]) for x in s or ()])
        names = sorted(set(i or ()), key=lambda x: x.encode("utf-8", "surrogatepass"))
        digest = hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest()
        out.append({"n_hit": sum(b - a for a, b in merged), "n_items": len(names), "items_sha256": digest})
    return pa.array(out, pa.struct([("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with a struct ``contamination``: ``n_words``, hit ``spans`` of word numbers and ``items``.

    A null text has no words. Items with the same id are one item; a null id is the empty one. The column is
    renamed with a trailing underscore when ``docs`` has one of that name. With an empty benchmark nothing is hit.
    """
    name = free_name(docs, "contamination")
    blocks = item_blocks(benchmark, item, item_text)
    out = docs.withColumn(name, find_items(named(text), next(blocks, [])))
    for block in blocks:  # a further pass over the texts, kept beside the hits so far
        more, out = free_name(out, "more"), materialize(out, "block")
        out = out.withColumn(more, find_items(named(text), block))
        both = F.struct(
            F.col(f"{more}.n_words").alias("n_words"),
            F.concat(F.col(f"{name}.spans"), F.col(f"{more}.spans")).alias("spans"),
            F.concat(F.col(f"{name}.items"), F.col(f"{more}.items")).alias("items"),
        )
        out = out.withColumn(name, both).drop(more)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, columns as they are."""
    name = free_name(docs, "contamination")
    found = contamination(docs, benchmark, text)
    return found.filter(F.size(F.col(f"{name}.spans")) == 0).select(*[named(c) for c in docs.columns])


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words, items and the verdict per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    c, summary = F.col("contamination"), arrow_udf(_summary, SUMMARY)
    counted = found.select("doc_id", c["n_words"].alias("n_words"), summary(c["spans"], c["items"]).alias("s"))
    return counted.select("doc_id", "n_words", "s.*", (F.col("s.n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " + (
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, p, n, item FROM places JOIN windows USING (n, win)),
words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
