"""Mixing sources to target weights by the cube method.

Every document's inclusion ratio is its source's target over the source's size: whole copies are certain, the rest is
an inclusion probability. The flight phase moves the probabilities of three documents at a time along the null space
of the two balancing constraints (tokens and documents of the source) until one of them is 0 or 1, so both totals stay
as they are. Documents of a source are dealt over blocks of bounded size by hash; a few documents a block remain
undecided and go to the next level, until one block per source is left. There the flight ends with the last sixteen
documents: the landing problem, small enough to try all outcomes. The one that misses the
totals least is taken.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import WORD, free_name, in_order, materialize, named, small, table, with_row_ids

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3
#: Documents of one flight at most, on average.
BLOCK = 4096
#: Undecided documents of a source that are left to the landing; all their outcomes are tried.
LANDING = 16
#: Undecided documents that a block leaves to the next level.
LEAVE = 8


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, keys: list, name: str) -> DataFrame:
    """``df`` with ``place``, the number of a row in order of ``keys`` from 0, without a single-task sort."""
    ranged = in_order(df, keys, name)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("shard").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard").orderBy(*[k.asc_nulls_last() for k in keys])) - 1
    return ranged.join(F.broadcast(offsets), "shard").withColumn("place", F.col("offset") + inside).drop("shard", "offset")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, n, place, target`` per source of ``rows`` (``source, size``).

    Sources in order of code points (null last) weigh ``weights``, repeating, and share the sum of all sizes. A
    target stops at ``most`` times the source's size; the excess is shared again by weight until none is above.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = numbered(totals, [F.col("source")], "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialize(placed.withColumn("weight", weight.cast("double")), "weights")
    cap = F.col("source_size") * F.lit(float(most))
    whole = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    level, full = (whole.t / whole.w if whole.w else 0.0), -1
    while True:
        above = F.col("weight") * level >= cap
        now = sources.agg(
            F.count_if(above).alias("full"), F.sum(F.when(above, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if now.full == full or not now.open:
            break
        full, level = now.full, (whole.t - now.held) / now.open
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def flight(p: list[float], size: list[float], draw: Callable[[], float], leave: int = 2) -> list[float]:
    """Move ``p`` to 0 or 1 until ``leave`` entries (2 at least) or fewer are open, keeping its sum and that of ``p * size``."""
    places, open_ = [i for i, x in enumerate(p) if 0.0 < x < 1.0], []
    for seen, i in enumerate(places):
        open_.append(i)
        if len(open_) + len(places) - seen - 1 <= leave:
            return p
        if len(open_) < 3:
            continue
        a, b, c = open_
        move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if move == (0, 0, 0):
            move = (1.0, -1.0, 0.0)  # equal sizes: both constraints are the same one
        _step(p, open_, move, draw)
        open_ = [k for k in open_ if 0.0 < p[k] < 1.0]
    if len(open_) == 2 and size[open_[0]] == size[open_[1]]:
        _step(p, open_, (1.0, -1.0), draw)
    return p


def _step(p: list[float], places: list[int], move: tuple[float, ...], draw: Callable[[], float]) -> None:
    """One step to a face of the cube, up or down so that no probability changes on average."""
    up = min((1 - p[k]) / u if u > 0 else p[k] / -u for k, u in zip(places, move) if u)
    down = min(p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in zip(places, move) if u)
    by = up if draw() * (up + down) < down else -down
    for k, u in zip(places, move):
        x = p[k] + by * u
        p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def land(p: list[float], size: list[float]) -> list[float]:
    """Decide the last entries, ``LANDING`` at most, by the outcome that misses the sums of ``p * size`` and ``p`` least."""
    left = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    if left:
        share, words = np.array([p[i] for i in left]), np.array([size[i] for i in left])
        outcomes = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        missed = outcomes - share
        # A document too many weighs as a twentieth of an average one's words: tokens come first.
        best = outcomes[np.argmin(np.abs(missed @ words) + 0.05 * words.mean() * np.abs(missed.sum(axis=1)))]
        for i, taken in zip(left, best.tolist()):
            p[i] = float(taken)
    return p


def _fly(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def fly(block: pa.Table) -> pa.Table:
        order = block.sort_by("_h")  # mixed sizes are left to land: small and large ones can make up for each other
        place, number = order.column("place")[0].as_py(), order.column("block")[0].as_py()
        draw = random.Random(f"{place}/{level}/{number}").random
        size = [float(x) for x in order.column("size").to_pylist()]
        p = flight(order.column("p").to_pylist(), size, draw, LANDING if last else LEAVE)
        p = land(p, size) if last else p
        return order.set_column(order.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return fly


def mix(
    rows: DataFrame, keys: list[str], weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK
) -> DataFrame:
    """``keys, size, source, source_size, target, copies``, one row per row of ``rows`` (``keys, size, source``).

    Rows equal in all these columns are interchangeable; they are counted before they are dealt, so that a hot key
    moves as one row. The result depends on the rows alone, not on how they are partitioned: draws are seeded by
    source and block, and blocks and their order follow from a hash of the keys. Sources without words get nothing.
    """
    sources = targets(rows, weights, most)
    kinds = rows.groupBy(*keys, "size", "source").agg(F.count("*").alias("_m"))
    kinds = kinds.withColumnRenamed("source", "_s").join(small(sources), F.expr("_s <=> source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    p = F.when(ratio - whole < 1e-9, 0.0).otherwise(ratio - whole)
    units = kinds.select(
        *keys, "size", "source", "source_size", "target", "n", "place", whole.alias("_whole"), p.alias("p"),
        F.explode(F.sequence(F.lit(1).cast("long"), "_m")).alias("_k"),
    ).withColumn("_h", F.xxhash64(*keys, "size", "_k"))
    blocks = F.ceil(F.col("n") / block)
    longest = sources.agg(F.max("n")).first()[0] or 0
    done, level, most_blocks = [], 0, -(-longest // block)
    while True:
        last = most_blocks <= 1
        undecided = units.filter("p > 0 AND p < 1")
        dealt = undecided.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "_h"), blocks))
        flown = dealt.groupBy("place", "block").applyInArrow(_fly(level, last), dealt.schema).drop("block")
        done.append(units.filter("p = 0 OR p = 1"))
        units = materialize(flown, f"flight{level}")
        if last:
            break
        blocks, most_blocks, level = F.ceil(LEAVE * blocks / block), -(-LEAVE * most_blocks // block), level + 1
    done.append(units)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    copies = (F.col("_whole") + F.col("p")).cast("long").alias("copies")
    return every.select(*keys, "size", "source", "source_size", "target", copies)


def resample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns as they are.

    Equal rows are one kind; its copies are made from the first of them, so the result depends on the rows alone.
    """
    rid = free_name(docs, "rid")
    numbered_docs = with_row_ids(docs, "numbered", rid)
    content = F.xxhash64(*[named(c).cast("string") for c in docs.columns])
    thin = numbered_docs.select(
        named(rid).alias("_r"), named(key).alias("_key"), content.alias("_c"),
        word_count(named(text)).alias("size"), named(source).alias("source"),
    )
    thin = materialize(thin, "thin")
    taken = mix(thin.drop("_r"), ["_key", "_c"]).groupBy("_key", "_c", "size", "source").agg(F.sum("copies").alias("_n"))
    first = thin.groupBy("_key", "_c", "size", "source").agg(F.min("_r").alias("_r"))
    same = " AND ".join(f"t.{c} <=> f.{c}" for c in ("_key", "_c", "size", "source"))
    chosen = taken.filter("_n > 0").alias("t").join(first.alias("f"), F.expr(same)).select(
        F.col("_r").alias(rid), F.col("_n").alias(free_name(numbered_docs, "n"))
    )
    chosen = materialize(chosen, "chosen")
    times = named(chosen.columns[1])
    joined = numbered_docs.join(small(chosen), rid)
    again = F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(free_name(joined, "k"))
    return joined.select(*[named(c) for c in docs.columns], again).select(*[named(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    thin = materialize(docs.select("doc_id", word_count(F.col("text")).alias("size"), "source"), "sizes")
    mixed = mix(thin, ["doc_id"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
