"""Language-model scores from class-based n-grams (Brown clustering by exchange).

Every word belongs to one class. A text's probability is the product, over its tokens, of the chance of the token's
class after the class before it and the chance of the token inside its class.

*Clustering.* What is exchanged between classes are units: a word seen ``least_count`` times or more is a unit of its
own, rarer words are exchanged together by their ending, which gives words never seen a class too. The most frequent
units seed one class each; every other unit then joins the class under which its neighbours are likeliest. After that
come exchange sweeps: a unit moves to the class that raises the likelihood most, all other units as they were at the
start of the sweep; one part of the units moves per sweep, so that neighbours don't chase each other.

*Layout.* Nothing here holds the vocabulary, which grows with the corpus, in one place. Texts are cut into chunks of
bounded size; inside a chunk words are small numbers, and only the chunk's distinct words are shuffled: once by word to
add up counts, then per sweep by unit to fetch classes. The numbered texts lie in a table bucketed by chunk, so that
no sweep shuffles them again. The classes of units are sent to all tasks where they were counted to fit, else joined by
a shuffle of the chunks' units; everything else that is sent is a square of the number of classes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from batchloom.llm.common import free_name, materialize, named, remove, scratch, small, table

CLASSES = 64
#: A word seen less often is exchanged together with the others of its ending.
LEAST_COUNT = 50
#: Bytes of an ending.
ENDING = 3
SWEEPS = 2
#: One of so many parts of the units moves per sweep.
PARTS = 2
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Added to the transitions of every class, spread like the classes themselves.
PRIOR = 5.0
BASE_ADDED = 0.1

#: No word's hash is looked for under this text, since UTF-8 has no such byte.
_MARK = b"\xff"


def tokens_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only, as UTF-8; the end token is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only


# Numbering the words of chunks


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 packed, their low, middle and high bytes apart, since most high ones are zero."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T), 1)


def _wide(packed: bytes) -> np.ndarray:
    bytes_ = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(bytes_.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Chunk:
    """Texts of one chunk as numbers of its distinct words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.keys, self.held, self.texts, self.size = [], [], [], 0

    def add(self, key, held: bool, text: str | None) -> None:
        place, words = self.words.setdefault, self.words
        found = tokens_of(text)
        self.texts.append(np.fromiter((place(w, len(words)) for w in found), np.int64, len(found)))
        self.keys.append(key)
        self.held.append(held)
        self.size += len(text or "")

    def batches(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row per text, and one per distinct word with its count in the texts that are learned from."""
        nothing = np.zeros(0, np.int64)
        learned = [ids for ids, held in zip(self.texts, self.held) if not held]
        counts = np.bincount(np.concatenate([nothing, *learned]), minlength=len(self.words))
        seen = np.bincount(np.concatenate([nothing, *self.texts]), minlength=len(self.words))
        rank = np.empty(len(seen), np.int64)
        rank[np.argsort(-seen, kind="stable")] = np.arange(len(seen))
        n, m = len(self.texts), len(self.words)
        texts = [_narrow(rank[ids]) for ids in self.texts]
        yield _batch(schema, n, chunk=[number] * n, key=self.keys, held=self.held, ids=texts)
        words = pa.array(list(self.words), pa.binary())
        yield _batch(schema, m, chunk=[number] * m, place=rank, word=words, n=counts)


def _type(rows: DataFrame) -> str:
    return rows.schema["key"].dataType.simpleString()


def _arrow_schema(spark: SparkSession, kind: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], kind).schema)


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch of ``schema``; columns not named are null."""
    arrays = []
    for field in schema:
        values = columns.get(field.name)
        if values is None:
            values = pa.nulls(rows, field.type)
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _numbered(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of texts ``(chunk, key, held, ids)`` and of distinct words ``(chunk, place, word, n)``, written."""
    kind = f"chunk long, key {_type(docs)}, held boolean, ids binary, place int, word binary, n long"
    schema = _arrow_schema(docs.sparkSession, kind)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk = TaskContext.get().partitionId() << 24, _Chunk()
        for batch in batches:
            for key, held, text in zip(*batch.columns):
                if chunk.texts and chunk.size + len(text.as_py() or "") > chunk_bytes:
                    yield from chunk.batches(at, schema)
                    at, chunk = at + 1, _Chunk()
                chunk.add(key.as_py(), held.as_py(), text.as_py())
        if chunk.texts:
            yield from chunk.batches(at, schema)

    return materialize(docs.select("key", "held", "text").mapInArrow(number, kind), "numbered", "zstd")


# Counts


@dataclass(frozen=True)
class Totals:
    """Of all tokens learned from: their number, distinct ones, ends, and the discount of counts."""

    tokens: int
    types: int
    ends: int
    discount: float

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + BASE_ADDED) / (self.tokens + BASE_ADDED * (self.types + 1)))


def _unit(word: Column, count: Column, least_count: int) -> Column:
    ending = F.concat(F.lit(_MARK), F.expr(f"substring(word, -{ENDING}, {ENDING})"))
    return F.xxhash64(F.when(count >= least_count, word).otherwise(ending))


def _end_unit() -> Column:
    return F.xxhash64(F.lit(_MARK + _MARK))


def _counted(numbered: DataFrame, least_count: int) -> DataFrame:
    """``(chunk, place, c, unit, first)`` of every distinct word of a chunk; one chunk of each word is its first."""
    by_word = Window.partitionBy("word")
    words = numbered.filter("word IS NOT NULL").select("chunk", "place", "word", "n")
    words = words.withColumns({"c": F.sum("n").over(by_word), "first": F.min("chunk").over(by_word) == F.col("chunk")})
    unit = _unit(F.col("word"), F.col("c"), least_count).alias("unit")
    return materialize(words.select("chunk", "place", "c", unit, "first"), "counted", "zstd")


def _totals(numbered: DataFrame, counted: DataFrame) -> Totals:
    once = counted.filter("first")
    found = once.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"),
        F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"),
    ).first()
    ends = numbered.filter("ids IS NOT NULL AND NOT held").count()
    discount = found.n1 / (found.n1 + 2 * found.n2) if found.n1 and found.n2 else 0.5
    return Totals(found.n + ends, found.v + (ends > 0), ends, min(max(discount, 0.1), 0.9))


_UNITS = "chunk long, key {0}, held boolean, n_tokens long, n_known long, base_score double, known double, " + (
    "ids binary, place int, unit long, seen boolean"
)


def _in_units(numbered: DataFrame, counted: DataFrame, totals: Totals) -> DataFrame:
    """Texts as numbers of units, with what does not depend on classes; and the units of each chunk.

    Texts: ``(chunk, key, held, n_tokens, n_known, base_score, known, ids)``; ``known`` adds up log10(count -
    discount). Units: ``(chunk, place, unit, seen)``; the end is place 0, words not learned from have places of their
    own. Written bucketed by chunk.
    """
    spark, kind = numbered.sparkSession, _UNITS.format(_type(numbered))
    schema = _arrow_schema(spark, kind)

    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        place = words["place"].to_numpy()
        count, unit = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], unit[place] = words["c"].to_numpy(), words["unit"].to_numpy()
        seen, others = np.unique(unit[count > 0]), np.unique(unit[count == 0])
        number = 1 + np.where(count > 0, np.searchsorted(seen, unit), len(seen) + np.searchsorted(others, unit))
        base, known = totals.base(count), np.log10(np.maximum(count - totals.discount, 0.1))
        known[count == 0] = 0.0
        end = float(totals.base(np.array([totals.ends]))[0])
        rows = {"n_tokens": [], "n_known": [], "base_score": [], "known": [], "ids": []}
        for packed in texts["ids"]:
            ids = _wide(packed.as_py())
            rows["n_tokens"].append(len(ids) + 1)
            rows["n_known"].append(int((count[ids] > 0).sum()) + (totals.ends > 0))
            rows["base_score"].append(float(base[ids].sum()) + end)
            rows["known"].append(float(known[ids].sum()))
            rows["ids"].append(_narrow(number[ids]))
        units = np.concatenate([[0], seen, others])
        n, m, chunk = len(texts), len(units), texts["chunk"][0].as_py()  # no chunk is without a text
        held, keys = texts["held"].combine_chunks(), texts["key"].combine_chunks()
        return pa.Table.from_batches([
            _batch(schema, n, chunk=[chunk] * n, held=held, key=keys, **rows),
            _batch(schema, m, chunk=[chunk] * m, place=np.arange(m, dtype=np.int32), unit=units, seen=np.arange(m) <= len(seen)),
        ])

    texts = numbered.filter("ids IS NOT NULL").select("chunk", "key", "held", "ids").groupBy("chunk")
    found = texts.cogroup(counted.select("chunk", "place", "c", "unit").groupBy("chunk")).applyInArrow(join, kind)
    found = found.withColumn("unit", F.when(F.col("place") == 0, _end_unit()).otherwise(F.col("unit")))
    return _bucketed(spark, found, "chunk")


def _bucketed(spark: SparkSession, rows: DataFrame, column: str) -> DataFrame:
    """A written copy that needs no shuffle to be grouped by ``column``."""
    name, buckets = f"brown_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, column).option("path", scratch(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


# Exchange


def _counts(in_units: DataFrame, classes: DataFrame, k: int, may_move: Column | None) -> DataFrame:
    """What the learned texts hold under ``classes``, written: class pairs, and the neighbours of units that may move.

    Pairs have no ``unit``, and ``at`` is the class before times ``k`` plus the class. The others say how often a unit
    stands after class ``at``, or before class ``at - k``. ``may_move`` looks at ``unit`` and ``cls``, -1 for none.
    """

    def count(texts: pa.Table, units: pa.Table) -> pa.Table:
        size = len(units)
        place = units["place"].to_numpy()
        cls, unit, may = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
        cls[place], unit[place] = units["cls"].to_numpy(), units["unit"].to_numpy()
        may[place] = units["may"].to_numpy(zero_copy_only=False)
        # All texts of the chunk behind each other, each with an end before its first and after its last token.
        ids = [x for packed in texts["ids"] for x in (_wide(packed.as_py()), [0])]
        ids = np.concatenate([[0], *ids]).astype(np.int64)
        before, after = ids[:-1], ids[1:]
        first, second = cls[before], cls[after]
        both = (first >= 0) & (second >= 0)
        pairs = np.bincount(first[both] * k + second[both], minlength=k * k)
        at = np.flatnonzero(pairs)
        left, right = may[after] & (first >= 0), may[before] & (second >= 0)
        near = np.concatenate([after[left] * (2 * k) + first[left], before[right] * (2 * k) + k + second[right]])
        near, n = np.unique(near, return_counts=True)
        return pa.table({
            "unit": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(unit[near // (2 * k)], pa.int64())]),
            "at": pa.array(np.concatenate([at, near % (2 * k)]), pa.int32()),
            "n": pa.array(np.concatenate([pairs[at], n]), pa.int64()),
        })

    may = F.lit(False) if may_move is None else may_move
    found = _with_classes(in_units, classes, count, "unit long, at int, n long", learned=True, may=may)
    return materialize(found.groupBy("unit", "at").agg(F.sum("n").alias("n")), "counts")


def _with_classes(
    in_units: DataFrame, classes: DataFrame, work, schema: str, learned: bool, **columns: Column
) -> DataFrame:
    """``work`` on the texts of each chunk and its units with their class, -1 where they have none."""
    # Both sides are the same table: the units get columns of their own.
    own = [F.col(c).alias(c) for c in ("chunk", "place", "unit", "seen")]
    units = in_units.filter("unit IS NOT NULL").select(*own)
    units = units.join(small(classes), "unit", "left").withColumn("cls", F.coalesce("cls", F.lit(-1)))
    texts = in_units.filter("ids IS NOT NULL" + (" AND NOT held" if learned else ""))
    return texts.groupBy("chunk").cogroup(units.withColumns(columns).groupBy("chunk")).applyInArrow(work, schema)


def _pairs(counts: DataFrame, k: int) -> np.ndarray:
    """Class pairs ``[before, class]``: ``k`` squared rows at most."""
    pairs = np.zeros(k * k)
    for r in counts.filter("unit IS NULL").collect():
        pairs[r.at] = r.n
    return pairs.reshape(k, k)


def exchange_scores(pairs: np.ndarray) -> np.ndarray:
    """What one neighbour adds to the likelihood of a unit, per class: rows are the ``at`` of a unit's neighbours.

    The pointwise mutual information of two classes, with half an expected pair added.
    """
    before, after = pairs.sum(axis=1) + 1e-9, pairs.sum(axis=0) + 1e-9
    expected = np.outer(before, after) / before.sum()
    together = np.log((pairs + 0.5 * expected + 1e-6) / (expected + 1e-6))
    return np.vstack([together, together.T])


def _moved(counts: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``classes`` with each unit that has neighbours in ``counts`` in its best class, written."""
    scores = exchange_scores(_pairs(counts, k))
    near = counts.filter("unit IS NOT NULL").groupBy("unit")
    near = near.agg(F.collect_list(F.struct("at", "n")).alias("near"))  # 2 k entries at most

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column(1)
            at, n = near.flatten().flatten()
            row = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy())
            counts = np.zeros((len(near), 2 * k))
            counts[row, at.to_numpy()] = n.to_numpy()
            fit = np.round(counts @ scores, 6)[:, 1:]  # class 0 is the end's
            best = pa.array(fit.argmax(axis=1).astype(np.int32) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), best], ["unit", "best"])

    best = near.mapInArrow(choose, "unit long, best int")
    found = classes.join(best, "unit", "left").select("unit", F.coalesce("best", "cls").alias("cls"))
    return materialize(found, "classes")


@dataclass
class Model:
    """``classes (unit, cls)`` as a written table, and what is known of each class."""

    classes: DataFrame
    totals: Totals
    pairs: np.ndarray
    counts: np.ndarray
    types: np.ndarray

    def steps(self) -> np.ndarray:
        """log10 of the chance of a class after a class."""
        k = len(self.counts)
        share = (self.counts + 0.1) / (self.counts.sum() + 0.1 * k)
        return np.log10((self.pairs + PRIOR * share) / (self.pairs.sum(axis=1, keepdims=True) + PRIOR))

    def seen(self) -> np.ndarray:
        """To be added to log10(count - discount) of a known word of each class; the end is alone in class 0."""
        return np.concatenate([[0.0], -np.log10(np.maximum(self.counts[1:], 1))])

    def unseen(self) -> np.ndarray:
        """log10 of the chance of a word never seen inside each class: all that was discounted there."""
        mass = self.totals.discount * self.types / np.maximum(self.counts, 1)
        return np.where(self.types > 0, np.log10(np.maximum(mass, 1e-300)), 0.0)

    def usual(self) -> int:
        """The class of words without one: that of most distinct words."""
        return int(self.types[1:].argmax()) + 1


def _units(counted: DataFrame) -> DataFrame:
    """``(unit, n, types)``: tokens and distinct words of each unit."""
    words = counted.filter("first AND c > 0").groupBy("unit")
    return materialize(words.agg(F.sum("c").alias("n"), F.count("*").alias("types")), "units")


def _learn(in_units: DataFrame, units: DataFrame, totals: Totals, k: int, sweeps: int) -> Model:
    spark = in_units.sparkSession
    seeds = units.orderBy(F.desc("n"), "unit").limit(k - 1).collect()
    end = spark.range(1).select(_end_unit().alias("unit")).first().unit
    fixed = [(r.unit, i + 1) for i, r in enumerate(seeds)] + [(end, 0)]
    fixed = spark.createDataFrame(fixed, "unit long, cls int")
    spread = F.pmod("unit", F.lit(k - 1)).cast("int") + 1  # for units that never stand beside a seed
    others = units.select("unit").join(F.broadcast(fixed), "unit", "left_anti").select("unit", spread.alias("cls"))
    classes = _moved(_counts(in_units, fixed, k, F.col("cls") < 0), others.unionByName(fixed), k)
    for sweep in range(sweeps):
        may_move = (F.pmod("unit", F.lit(PARTS)) == sweep % PARTS) & (F.col("cls") > 0)
        classes = _moved(_counts(in_units, classes, k, may_move), classes, k)
    counts, types = np.zeros(k), np.zeros(k)
    for r in units.join(classes, "unit").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("types").alias("t")).collect():
        counts[r.cls], types[r.cls] = r.n, r.t
    counts[0] = totals.ends
    return Model(classes, totals, _pairs(_counts(in_units, classes, k, None), k), counts, types)


# Scores


def _scored(in_units: DataFrame, model: Model) -> DataFrame:
    steps, seen, unseen, usual = model.steps(), model.seen(), model.unseen(), model.usual()
    nothing = model.totals.tokens == 0
    schema = f"key {_type(in_units)}, held boolean, n_tokens long, n_known long, base_score double, score double"

    def add(texts: pa.Table, units: pa.Table) -> pa.Table:
        cls, known = np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        place = units["place"].to_numpy()
        cls[place], known[place] = units["cls"].to_numpy(), units["seen"].to_numpy(zero_copy_only=False)
        cls[cls < 0] = usual
        cls[0] = 0
        alone = np.where(known, seen[cls], unseen[cls])
        scores = []
        for packed, before in zip(texts["ids"], texts["known"]):
            ids = np.concatenate([[0], _wide(packed.as_py()), [0]])
            c = cls[ids]
            scores.append(before.as_py() + float(steps[c[:-1], c[1:]].sum() + alone[ids[1:]].sum()))
        if nothing:
            scores = texts["base_score"].to_pylist()
        kept = texts.select(["key", "held", "n_tokens", "n_known", "base_score"])
        return kept.append_column("score", pa.array(scores, pa.float64()))

    return _with_classes(in_units, model.classes, add, schema, learned=False)


def fit_and_score(
    docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id", classes: int = CLASSES,
    sweeps: int = SWEEPS, least_count: int = LEAST_COUNT, chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, Model]:
    """Scores of all rows, by a model of the rows that are not ``held``; one row per row, and the model.

    ``(key, held_out, n_tokens, n_known, base_score, score)``: the token counts include the end; ``base_score`` is the
    text's log10 probability under single words with ``BASE_ADDED`` added to each count, ``score`` under the classes.
    A null text is an empty one. Without any row to learn from, the score is the base score.
    """
    rows = docs.select(named(key).alias("key"), held.alias("held"), named(text).alias("text"))
    numbered = _numbered(rows, chunk_bytes)
    counted = _counted(numbered, least_count)
    totals = _totals(numbered, counted)
    units = _units(counted)
    in_units = _in_units(numbered, counted, totals)
    for done in (numbered, counted):
        remove(done)
    model = _learn(in_units, units, totals, classes, sweeps)
    found = _scored(in_units, model).withColumnRenamed("held", "held_out")
    return found.withColumnRenamed("key", key if key != "held_out" else free_name(found, key)), model


def held_out(key: Column) -> Column:
    """A tenth of the keys, by the checksum of their text; a null key is the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def op12_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under class-based bigrams and under single words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, model = fit_and_score(docs, held_out(F.col("doc_id")))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
