"""Quality classifier by co-training.

Two views of a document: what its text is made of (frequencies of neighbouring character classes, words), and its page
metadata (language, source, length, line layout). A logistic model is fitted on each view; in every round each one
labels the unlabelled documents it is surest of for the other. Each view is then calibrated on held-out labelled
rows, and the calibrated views are combined into one probability that scores all documents.

Fitting uses a bounded sample, taken by hash: ``LABELLED`` rows with a label and ``POOL`` without.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from batchloom.llm.common import free_name, named, table

#: Bounds of the rows that fitting reads.
LABELLED = 16_000
POOL = 8_000
ROUNDS = 3
#: Share of the pool that a view hands over per round, at most, and how sure it must be.
SHARE = 0.1
SURE = 0.95
#: Weight of a pseudo-label against a real one.
PSEUDO = 0.5
THRESHOLD = 0.5

# Character classes of UTF-8 bytes: bytes above 127 count as small letters.
_GROUPS = [b"\n", b" \t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
           b"0123456789", b".,;:", b"!?", b"'\"()-", b"|", b"#*$%&<>=+_~^@", b"/\\[]{}`"]
CLASSES = len(_GROUPS) + 1
_TABLE = np.full(256, len(_GROUPS), np.uint8)
for _number, _group in enumerate(_GROUPS):
    _TABLE[list(_group)] = _number
_TO_CLASS = _TABLE.tobytes()
CONTENT = CLASSES * CLASSES + 4
SOURCES, LANGS = 16, 8
META = SOURCES + LANGS + 8


def content_view(data: bytes) -> np.ndarray:
    """Square roots of class pair frequencies, then word measures."""
    out = np.zeros(CONTENT)
    if len(data) > 1:
        classes = np.frombuffer(data.translate(_TO_CLASS), np.uint8)
        pairs = np.bincount(classes[:-1].astype(np.int16) * CLASSES + classes[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(data) - 1))
    words = data.split()
    if words:
        out[-4:] = (
            (len(data) - len(words)) / len(words) / 10, len(set(words)) / len(words) ** 0.8,
            np.log1p(len(words)) / 10, len(set(words)) / len(words),
        )
    return out


def meta_view(data: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, and the layout of lines."""
    out = np.zeros(META)
    out[zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) % LANGS] = 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    if lines:
        n, chars = len(lines), len(data)
        ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / n
        marks = sum(data.count(x) for x in (b"|", b"#", b"*", b"$", b"%", b"&", b"!"))
        capital = sum(x.isupper() for x in lines) / n
        out[SOURCES + LANGS :] = (
            np.log1p(n) / 5, np.log1p(chars / n) / 10, len(set(lines)) / n, ends,
            min(1.0, 10 * marks / chars), capital, np.log1p(max(0, n_chars or 0)) / 10, data.count(b" ") / chars,
        )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ beta)
        hessian = (x.T * (weight * p * (1 - p))) @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def logit(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.clip(x @ beta[:-1] + beta[-1], -30, 30)


@dataclass
class Model:
    """Per view: centre, scale, weights and calibration; then the combination. ``constant`` replaces all of them."""

    views: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    both: np.ndarray | None = None
    constant: float | None = None

    def view_logits(self, features: list[np.ndarray]) -> np.ndarray:
        found = []
        for x, (centre, scale, beta, line) in zip(features, self.views):
            found.append(logit(logit((x - centre) / scale, beta)[:, None], line))
        return np.column_stack(found)

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined probability of good quality, and that of each calibrated view."""
        if self.constant is not None:
            same = np.full(len(content), self.constant)
            return same, same, same
        logits = self.view_logits([content, meta])
        return sigmoid(logit(logits, self.both)), sigmoid(logits[:, 0]), sigmoid(logits[:, 1])


def co_train(views: list[np.ndarray], labels: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit on rows of both ``views``; ``labels`` are 0, 1 or NaN (the pool), ``held`` marks rows for calibration.

    Without labels of both classes the model is a constant: the share of ones, and 1 without any label.
    """
    known = ~np.isnan(labels)
    if len(set(labels[known].tolist())) < 2 or len(set(labels[known & ~held].tolist())) < 2:
        return Model([], constant=float(labels[known].mean()) if known.any() else 1.0)
    scaled, shapes = [], []
    for x in views:
        centre, scale = x[known].mean(axis=0), x[known].std(axis=0) + 1e-3
        shapes.append((centre, scale))
        scaled.append((x - centre) / scale)
    prior = labels[known].mean()
    sets = [np.where(known & ~held, labels, np.nan) for _ in views]
    weights = [np.where(known, 1.0, PSEUDO) for _ in views]
    betas: list[np.ndarray] = []
    for step in range(rounds + 1):
        betas = []
        for x, y, w in zip(scaled, sets, weights):
            use = ~np.isnan(y)
            betas.append(fit_logistic(x[use], y[use], w[use]))
        if step == rounds:
            break
        for a, b in ((0, 1), (1, 0)):  # view a labels for view b
            free = np.flatnonzero(np.isnan(sets[b]) & ~known)
            p = sigmoid(logit(scaled[a][free], betas[a]))
            most = max(1, int(SHARE * (~known).sum()))
            for value, chance, part in ((1.0, p, prior), (0.0, 1 - p, 1 - prior)):
                order = np.argsort(-chance, kind="stable")[: max(1, int(most * part))]
                sets[b][free[order[chance[order] >= SURE]]] = value
    check = held & known if len(set(labels[held & known].tolist())) == 2 else known
    y, one = labels[check], np.ones(int(check.sum()))
    lines = [fit_logistic(logit(x[check], beta)[:, None], y, one, 0.1) for x, beta in zip(scaled, betas)]
    model = Model([(c, s, beta, line) for (c, s), beta, line in zip(shapes, betas, lines)])
    model.both = fit_logistic(model.view_logits([x[check] for x in views]), y, one, 0.1)
    return model


def _features(batch: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    content, meta = np.zeros((len(batch["text"]), CONTENT)), np.zeros((len(batch["text"]), META))
    for i, (text, lang, source, n) in enumerate(zip(batch["text"], batch["lang"], batch["source"], batch["n_chars"])):
        data = (text or "").encode("utf-8", "surrogatepass")
        content[i], meta[i] = content_view(data), meta_view(data, lang, source, n)
    return content, meta


def _inputs(docs: DataFrame, text: str, lang: str, source: str, n_chars: str) -> list:
    return [named(text), named(lang).cast("string"), named(source).cast("string"), named(n_chars).cast("long")]


_COLUMNS = ("text", "lang", "source", "n_chars")


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", labelled: int = LABELLED,
    pool: int = POOL, text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars",
) -> Model:
    """Fit on at most ``labelled`` documents with a label and ``pool`` without, chosen by hash of the key.

    Null labels and keys are no labels; a key labelled more than once has its mean, rounded. Of the rows of one key the
    one with the smallest hash of its content is read.
    """
    known = labels.filter(named(key).isNotNull() & named(label).isNotNull()).groupBy(named(key).alias("_key"))
    known = known.agg(F.round(F.avg(named(label))).alias("_label"))
    ids = docs.select(named(key).alias("_key")).filter("_key IS NOT NULL").distinct()
    order = F.xxhash64(F.col("_key").cast("string"))
    some = ids.join(known, "_key").orderBy(order, "_key").limit(labelled)
    free = ids.join(known, "_key", "left_anti").orderBy(order, "_key").limit(pool).withColumn("_label", F.lit(None))
    chosen = some.unionByName(free.select("_key", F.col("_label").cast("double")))

    @arrow_udf("binary")  # four bytes a feature: the driver holds the whole sample
    def features(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for_batch = _features({c: v.to_pylist() for c, v in zip(_COLUMNS, columns)})
            yield pa.array([row.tobytes() for row in np.hstack(for_batch).astype("<f4")], pa.binary())

    inputs = _inputs(docs, text, lang, source, n_chars)
    picked = docs.withColumn(free_name(docs, "_key"), named(key)).select(named(key).alias("_key"), *[
        c.alias(n) for c, n in zip(inputs, _COLUMNS)
    ]).join(F.broadcast(chosen), "_key")  # bounded by labelled + pool thin rows
    content = F.struct(F.xxhash64(*_COLUMNS).alias("h"), *_COLUMNS)
    picked = picked.groupBy("_key", "_label").agg(F.min(content).alias("c")).select("_key", "_label", "c.*")
    rows = picked.select("_key", "_label", features(*_COLUMNS).alias("f")).toPandas()
    if rows.empty:
        return co_train([np.zeros((0, CONTENT)), np.zeros((0, META))], np.empty(0), np.empty(0, bool))
    rows = rows.assign(_order=rows["_key"].astype(str)).sort_values("_order", kind="stable")
    x = np.frombuffer(b"".join(map(bytes, rows["f"])), "<f4").reshape(len(rows), CONTENT + META).astype(float)
    held = np.array([zlib.crc32(f"held {k}".encode()) % 4 == 0 for k in rows["_order"]])
    return co_train([x[:, :CONTENT], x[:, CONTENT:]], pd.to_numeric(rows["_label"]).to_numpy(float), held)


def scored(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", lang: str = "lang",
    source: str = "source", n_chars: str = "n_chars",
) -> DataFrame:
    """``docs`` with a struct ``quality``: ``score`` (probability of good quality), one per view, and ``kept``."""

    @arrow_udf("struct<score:double,content:double,meta:double,kept:boolean>")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            found = model.score(*_features({c: v.to_pylist() for c, v in zip(_COLUMNS, columns)}))
            yield pa.StructArray.from_arrays(
                [*map(pa.array, found), pa.array(found[0] >= threshold)], ["score", "content", "meta", "kept"]
            )

    judged = score.asNondeterministic()(*_inputs(docs, text, lang, source, n_chars))
    return docs.withColumn(free_name(docs, "quality"), judged)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns as they are."""
    name = free_name(docs, "quality")
    found = scored(docs, train(docs, labels), threshold)
    return found.filter(F.col(f"{name}.kept")).select(*[named(c) for c in docs.columns])


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *_COLUMNS)
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "quality.*")
