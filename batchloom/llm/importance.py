"""Importance resampling towards a target distribution, weights by bit-sliced aggregation.

Features are runs of consecutive words, hashed into buckets. Raw and target texts give every bucket a gain, the
logarithm of how much likelier the target makes it, as an integer. A document's weight is the sum of the gains of its
features. It is worked out without multiplying: bit ``i`` of all bucket counts of a document is one plane of as many
bits as there are buckets, bit ``j`` of all gains is another (one set of planes for gains above zero, one for those
below), and

    weight = sum over i, j of 2**(i + j) * (ones(count_i AND above_j) - ones(count_i AND below_j))

which is exact for counts and gains of any size. The draw is without replacement: a Gumbel number made from the key is
added to the weight and the highest sums win.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from batchloom.llm.common import free_name, materialize, named, table

BUCKETS = 10_000
#: Features are runs of one to this many words.
LONGEST = 1
LEAST_WORDS = 20
PER_CENT = 10
SEED = "2024"
#: Documents whose counts are laid out beside each other at a time.
TOGETHER = 64

# Bytes of a text to those of its words: A-Z lower, all other ASCII but digits and letters a space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def bucket_numbers(text: str | None, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of features, and the distinct buckets with the number of features in each."""
    words = word_bytes(text)
    seen = Counter(words)
    for n in range(2, longest + 1):
        seen.update(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    where = np.fromiter(map(crc32, seen), np.int64, len(seen)) % buckets
    counts = np.fromiter(seen.values(), np.int64, len(seen))
    found, place = np.unique(where, return_inverse=True)
    totals = np.zeros(len(found), np.int64)
    np.add.at(totals, place, counts)
    return int(counts.sum()), found, totals


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """Features of all rows per bucket. Every task sends one row per bucket, whatever the rows it read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                _, found, n = bucket_numbers(t.as_py(), buckets, longest)
                totals[found] += n
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at])], ["bucket", "n"])

    made = texts.select(named(text).alias("text")).mapInArrow(count, "bucket long, n long")
    sums = {r.bucket: r.n for r in made.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row per bucket
    return [sums.get(b, 0) for b in range(buckets)]


def bucket_gains(raw: list[int], target: list[int]) -> list[int]:
    """``floor(1000 ln(share in the target / share in the raw texts))`` of every bucket, one added to each count."""
    k, s, t = len(raw), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log(((b + 1.0) * (s + k)) / ((a + 1.0) * (t + k)))) for a, b in zip(raw, target)]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    rows = np.packbits(bits.astype(bool), axis=-1)
    whole = np.zeros((*rows.shape[:-1], -(-rows.shape[-1] // 8) * 8), np.uint8)
    whole[..., : rows.shape[-1]] = rows
    return whole.view(np.uint64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of numbers from zero up: the first axis is the bit, the last one packs the numbers."""
    most = int(values.max(initial=0)).bit_length()
    return np.stack([_packed((values >> i) & 1) for i in range(most)]) if most else np.zeros(
        (0, *_packed(values).shape), np.uint64
    )


class SignedPlanes:
    """Gains as bit planes, those above zero and those below apart."""

    def __init__(self, gains: list[int]):
        self.buckets = len(gains)
        gains = np.array(gains, np.int64)
        self.above, self.below = planes(np.maximum(gains, 0)), planes(np.maximum(-gains, 0))

    def weights(self, counts: np.ndarray) -> list[int]:
        """Exact sum of gains per row of bucket counts."""
        totals = [0] * len(counts)
        for i, plane in enumerate(planes(counts)):
            for sign, gains in ((1, self.above), (-1, self.below)):
                for j, gain in enumerate(gains):
                    ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                    for row in np.flatnonzero(ones).tolist():
                        totals[row] += sign * (int(ones[row]) << (i + j))
        return totals


def feature_weights(text: Column, gains: list[int], longest: int = LONGEST) -> Column:
    """``struct(n_features, weight)`` of a text; the planes of the gains go to every task."""
    signed = SignedPlanes(gains)
    kind = pa.struct([("n_features", pa.int64()), ("weight", pa.int64())])

    @arrow_udf("struct<n_features:long,weight:long>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for first in range(0, len(texts), TOGETHER):
                some = texts.slice(first, TOGETHER)
                counts, numbers = np.zeros((len(some), signed.buckets), np.int64), []
                for row, t in enumerate(some):
                    n, found, totals = bucket_numbers(t.as_py(), signed.buckets, longest)
                    counts[row, found] = totals
                    numbers.append(n)
                out += [{"n_features": n, "weight": w} for n, w in zip(numbers, signed.weights(counts))]
            yield pa.array(out, kind)

    return weigh.asNondeterministic()(text)


def gumbel(key: Column, seed: str = SEED) -> Column:
    """``floor(1000 g)`` with a standard Gumbel number ``g`` made from the key; a null key is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text",
    per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """Key, ``n_features``, ``weight``, ``score`` and ``rank`` of every row; the drawn ones have ranks 1, 2, 3...

    Of the rows with ``least_words`` features or more, ``per_cent`` of a hundred are drawn, rounded down; equal scores
    go by the smaller key, null keys last. A null text has no features and weight 0, equal rows are drawn one by
    one, an empty target gives gains from the raw texts alone, and an empty table gives an empty result.
    """
    raw = bucket_counts(docs, text, buckets, longest)
    gains = bucket_gains(raw, bucket_counts(target, target_text, buckets, longest))
    found = docs.select(named(key).alias("key"), feature_weights(named(text), gains, longest).alias("f"))
    found = found.select("key", "f.*").withColumn("score", F.col("weight") + gumbel(F.col("key")))
    return ranked(materialize(found, "weights"), least_words, per_cent).withColumnRenamed("key", key)


_PLACES = 33  # bits of the row number inside a partition, in Spark's increasing ids


def ranked(weights: DataFrame, least_words: int, per_cent: int) -> DataFrame:
    """Add ``rank``: sorted by ranges, numbered inside each range, ranges put behind each other."""
    may = F.coalesce(F.col("n_features") >= least_words, F.lit(False))
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    spread = [F.xxhash64("n_features", "weight"), F.monotonically_increasing_id()]  # equal keys may fill many ranges
    kept = weights.filter(may).withColumns({"a": spread[0], "b": spread[1]})
    laid = kept.repartitionByRange(*order, "a", "b").sortWithinPartitions(*order, "a", "b").drop("a", "b")
    laid = materialize(laid.withColumn("place", F.monotonically_increasing_id()), "ranks")
    shard = F.shiftright("place", _PLACES)
    sizes = sorted((r.shard, r["count"]) for r in laid.groupBy(shard.alias("shard")).count().collect())
    before, starts = 0, []
    for number, size in sizes:  # one row per range
        starts.append((number, before))
        before += size
    starts = F.broadcast(weights.sparkSession.createDataFrame(starts, "shard long, start long"))
    rank = F.col("start") + F.col("place").bitwiseAND((1 << _PLACES) - 1) + 1
    drawn = laid.withColumn("shard", shard).join(starts, "shard").select(
        *weights.columns, F.when(rank <= before * per_cent // 100, rank).alias("rank")
    )
    return drawn.unionByName(weights.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``importance_rank`` (a free name) for rows whose key is drawn; the others are left out.

    ``key`` must be unique: ranks are joined back to the rows by it.
    """
    found = resample(docs, target, text, key, **options).filter("rank IS NOT NULL")
    mine, rank = free_name(docs, "importance_key"), free_name(docs, "importance_rank")
    found = found.select(named(key).alias(mine), F.col("rank").alias(rank))
    return docs.join(found, named(key).eqNullSafe(F.col(mine))).drop(mine)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " + (
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP13_SQL = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i)
  )
),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(word) + 1), lambda i:
      (instr('0123456789ABCDEF', substr(hex(word), 2 * i - 1, 1)) - 1) * 16
      + instr('0123456789ABCDEF', substr(hex(word), 2 * i, 1)) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc
),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN vocabulary USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS all_s, (SELECT count(*) FROM bw)::DOUBLE AS all_t),
gains AS (
  SELECT b AS bucket,
    floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b, totals
),
weights AS (
  SELECT r, sum(gain) AS weight FROM dw JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY r
),
scores AS (
  SELECT r, doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296
    )))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
),
ranks AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS all_n
  FROM scores WHERE n >= 20
)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN k <= 10 * all_n // 100 THEN k END AS "rank"
FROM scores LEFT JOIN ranks USING (r)
"""
