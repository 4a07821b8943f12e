"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

A short list of insults is extended by a lexicon learned from labelled texts: words and word beginnings that toxic texts
hold far more often than others.
Every text becomes a row of dense features: lexicon densities, nearness of the second person, capitals, punctuation
and obfuscation. Trees are fitted on most of the sample, their margin is calibrated on the rest. Only the text is an
input of the score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from batchloom.llm.common import free_name, materialize, named, small, table

#: Labelled rows that fitting reads, at most, chosen by hash of the key.
SAMPLE = 16_000
#: Lexicon entries at most, by strength of evidence (twice the log-likelihood ratio), which must reach EVIDENCE.
LEXICON = 4_000
EVIDENCE = 13.0
TREES, DEPTH = 40, 4
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: Words between a lexicon hit and a second person that still count as near.
NEAR = 6
#: Distinct words whose properties a task keeps.
MEMO_WORDS = 400_000
# Words that address the reader.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos usted ustedes tú ti".split()
)
# Common insults, which count as lexicon words also when the labels do not show them.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool jerk loser losers scum trash clown pathetic worthless disgusting ugly "
    "imbecile bastard asshole bitch shit fuck fucking damn crap hate "
    "dumm dummkopf trottel arschloch scheisse scheiße idioten "
    "con connard connasse salope merde imbécile crétin débile "
    "estúpido estúpida imbécil mierda puta cabrón gilipollas tonto"
).split()
INSULT_WEIGHT = 2.0
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
_EDGES = ".,;:!?\"'()[]{}<>|*#%&-_/\\=~^`"
_INNER = re.compile(r"[^\W\d_][\d@$!+*#.\-_][^\W\d_]|[@$013457][^\W\d_]{2}")
_NOT_LETTER = re.compile(r"[\W\d_]+")
FEATURES = (
    "hits per word", "weight per word", "log hits", "strongest hit", "kinds of hits", "hits that address", "address per word",
    "disguised hits", "disguised per word", "capitals per letter", "shouted words", "exclamations", "questions",
    "punctuation", "digits", "spaced letters", "log words",
)


def lexicon_terms(text: str | None) -> set[str]:
    """Distinct lower-case words of a text, and word beginnings marked with a star."""
    words = {t.strip(_EDGES) for t in (text or "").lower().split()}
    words.discard("")
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _evidence(pos: int, neg: int, all_pos: int, all_neg: int) -> tuple[float, float]:
    """Twice the log-likelihood ratio of a term's share of toxic texts against the overall share; and its log odds."""
    n, share = pos + neg, all_pos / (all_pos + all_neg)
    if pos <= share * n:
        return 0.0, 0.0
    ratio = pos * math.log(pos / n / share) + (neg * math.log(neg / n / (1 - share)) if neg else 0.0)
    return 2 * ratio, math.log((pos + 0.5) / (all_pos + 1)) - math.log((neg + 0.5) / (all_neg + 1))


def learn_lexicon(rows: DataFrame, limit: int = LEXICON) -> dict[str, float]:
    """Log odds of the terms with the best evidence; ``rows`` have ``text`` and ``label``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out():
            terms = list(seen)
            columns = [pa.array(terms), *(pa.array([seen[t][i] for t in terms], pa.int64()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["term", "neg", "pos"])

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                for term in lexicon_terms(text.as_py()):
                    seen[term][label] += 1
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    counted = rows.select("text", "label").mapInArrow(count, "term string, neg long, pos long")
    terms = counted.groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    # A term in fewer than three toxic texts cannot reach the evidence; the rest is a short list by its strength.
    whole = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    neg, pos = whole.get(0, 0), whole.get(1, 0)
    share = F.lit(pos / (pos + neg))
    n = F.col("pos") + F.col("neg")
    gain = F.col("pos") * F.log(F.col("pos") / n / share) + F.when(
        F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / n / (1 - share))
    ).otherwise(0.0)
    best = terms.filter("pos >= 3").filter(F.col("pos") > share * n).withColumn("gain", 2 * gain)
    best = best.filter(F.col("gain") >= EVIDENCE).orderBy(F.desc("gain"), "term").limit(limit)
    learned = {r.term: _evidence(r.pos, r.neg, pos, neg)[1] for r in best.collect()}
    return {**dict.fromkeys(INSULTS, INSULT_WEIGHT), **learned}


class Featurizer:
    """Dense features of texts, by a learned lexicon. Properties of a word are worked out once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memo: dict[str, int] = {}
        self.rows: list[tuple[float, ...]] = []
        self.kinds: dict[tuple[float, ...], int] = {}

    def _weight(self, word: str) -> float:
        found = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.lexicon.get(word[:n] + "*", 0.0))
        return found

    def _properties(self, token: str) -> int:
        """Number of the token's row: weight, second person, disguised weight, disguised, shouted, single letter."""
        core = token.strip(_EDGES)
        word = core.lower()
        weight, disguised = self._weight(word), 0.0
        odd = bool(_INNER.search(token.strip(".,;:!?\"'()")))
        if odd and not weight:
            disguised = self._weight(_NOT_LETTER.sub("", word.translate(_LEET)))
        row = (
            weight or disguised, float(word in SECOND_PERSON), disguised, float(odd),
            float(len(core) > 1 and core.isupper()), float(len(core) == 1 and core.isalpha()),
        )
        if row not in self.kinds:
            self.kinds[row] = len(self.rows)
            self.rows.append(row)
        if len(self.memo) < MEMO_WORDS:
            self.memo[token] = self.kinds[row]
        return self.kinds[row]

    def features(self, text: str | None) -> np.ndarray:
        text = text or ""
        tokens = text.split()
        n, out = len(tokens), np.zeros(len(FEATURES))
        if not n:
            return out
        get, memo = self._properties, self.memo
        places = np.fromiter((memo[t] if t in memo else get(t) for t in tokens), np.int64, n)
        p = np.array(self.rows)[places]
        weight, second, disguised, odd, shouted, single = p.T
        spelled = self._spelled(tokens, single)
        hits = np.flatnonzero(weight > 0)
        address = np.flatnonzero(second > 0)
        near = 0
        if len(hits) and len(address):
            after = np.searchsorted(address, hits)
            gap = np.minimum(
                np.abs(address[np.minimum(after, len(address) - 1)] - hits), np.abs(address[np.maximum(after - 1, 0)] - hits)
            )
            near = int((gap <= NEAR).sum())
        letters = max(1, len(text) - text.count(" "))
        capitals = _CAPITALS.subn("", text)[1]
        marks = sum(map(text.count, ".,;:!?"))
        digits = sum(map(text.count, "0123456789"))
        total = len(hits) + len(spelled)
        strongest = max([float(weight.max()), *spelled])
        out[:] = (
            total / n, (weight.sum() + sum(spelled)) / n, math.log1p(total), strongest, len({tokens[i] for i in hits.tolist()}),
            near / max(1, len(hits)), len(address) / n, (disguised > 0).sum() + len(spelled), odd.sum() / n,
            capitals / letters, shouted.sum() / n, text.count("!") / n, text.count("?") / n, marks / n, digits / letters,
            single.sum() / n, math.log1p(n),
        )
        return out

    def _spelled(self, tokens: list[str], single: np.ndarray) -> list[float]:
        """Weights of lexicon words that are spelled out letter by letter."""
        if single.sum() < 4:
            return []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
        found = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= 4 and (w := self._weight("".join(t.strip(_EDGES) for t in tokens[a:b]).lower())):
                found.append(w)
        return found


_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def dense_features(text: Column, lexicon: dict[str, float]) -> Column:
    """The features of a text column as ``array<double>``."""
    maker = Featurizer(lexicon)

    @arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([maker.features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return features.asNondeterministic()(text)


@dataclass
class Model:
    """Lexicon, trees and the calibration as steps ``(boundary, value)``; or a constant score."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    steps: list[tuple[float, float]] | None = None
    constant: float = 0.0


def sample_of(docs: DataFrame, labels: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """``(_key, label, text)`` of at most ``sample`` labelled keys, one row each: that of the smallest hash of its text."""
    known = labels.filter(named(key).isNotNull() & named(label).isNotNull()).groupBy(named(key).alias("_key"))
    known = known.agg(F.round(F.avg(named(label))).cast("int").alias("label"))
    texts = docs.select(named(key).alias("_key"), F.col("text"))
    order = F.xxhash64(F.col("_key").cast("string"))
    chosen = texts.select("_key").distinct().join(known, "_key").orderBy(order, "_key").limit(sample)
    known = texts.join(small(chosen), "_key").groupBy("_key", "label")
    text = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return materialize(known.agg(text.alias("text")), "labelled")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, chosen by hash of the key; ``labels`` must be training rows only.

    Null labels and keys are no labels; a key labelled more than once has its mean, rounded, and of several rows with
    one key one is read. Without labels of both classes the score is constant: the share of ones, 0 without any.
    """
    rows = sample_of(docs, labels, key, label, sample)
    whole = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not whole.get(0) or not whole.get(1):
        return Model({}, constant=1.0 if whole.get(1) else 0.0)
    lexicon = learn_lexicon(rows)
    x = array_to_vector(dense_features(F.col("text"), lexicon)).alias("features")
    held = F.pmod(F.xxhash64(F.lit("held"), F.col("_key").cast("string")), F.lit(5)) == 0
    made = materialize(rows.select("_key", F.col("label").cast("double"), x, held.alias("held")), "features")
    fit, check = made.filter(~F.col("held")), made.filter("held")
    if fit.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        fit = check = made
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=4, seed=7).fit(
        fit.orderBy("_key").coalesce(4)
    )
    margin = trees.transform(check).select("label", _chance(trees).alias("features"))
    # Copies share a margin: one weighted row for each, so that they are not dealt to one task.
    margin = margin.groupBy("features").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("rows"))
    curve = IsotonicRegression(weightCol="rows").fit(margin)
    return Model(lexicon, trees, list(zip(curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist())))


def _chance(trees: GBTClassificationModel) -> Column:
    return vector_to_array("probability")[1]


def _calibrated(chance: Column, steps: list[tuple[float, float]]) -> Column:
    """Linear between the boundaries of the isotonic fit; a hundredth of the raw chance keeps the order inside steps."""
    value = F.lit(steps[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(steps, steps[1:]))):
        between = F.lit(y0) + (chance - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)
        value = F.when(chance < x1, between).otherwise(value)
    value = F.when(chance <= steps[0][0], F.lit(steps[0][1])).otherwise(value)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * value + 0.01 * chance))


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); empty and null texts have a score too.

    The two columns get a trailing underscore where ``docs`` has one of that name.
    """
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    if model.trees is None:
        found = docs.withColumn(score, F.lit(model.constant))
    else:
        kept = F.struct(*[named(c) for c in docs.columns]).alias("_row")
        made = docs.select(kept, array_to_vector(dense_features(named(text), model.lexicon)).alias("features"))
        chance = model.trees.transform(made).select("_row", _chance(model.trees).alias("_chance"))
        found = chance.select("_row.*", _calibrated(F.col("_chance"), model.steps).alias(score))
    return found.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with remainder 1 are held out of all fitting."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = train(docs, labels.select("doc_id", "toxic").filter(~held_out))
    found = scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", "predicted")
