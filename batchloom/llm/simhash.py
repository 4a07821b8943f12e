"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are reduced to distinct values first, so copies cost nothing more. Two fingerprints within the
radius agree exactly on some of their parts, so tiles hold only fingerprints that agree on a set of parts, and
every pair within the radius shares a tile set: the search is exact. In a tile set, fingerprints are ordered by
population count and cut into tiles; tile pairs whose counts differ beyond the radius are skipped, all others are
compared whole, by numpy exclusive-or and bit counts. A comparison gives back a star per connected set and not
all pairs, so a group of thousands of near copies costs one edge per member.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from batchloom.llm.common import (
    components, free_name, materialize, named, small, table, with_row_ids,
)

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one tile at most; tiles of a set are compared in pairs.
TILE = 4096
#: Side of the square that is compared at once inside a tile pair.
BLOCK = 1024
BITS = 64


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of ``n`` words, repeats included; of the whole sequence when there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - n].tolist() if n > 1 else (ends - lengths).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64)


def simhash(text: str | None, n: int = SHINGLE) -> int:
    """Bit i is set when it is set in over half of the shingle hashes; 0 without words. As a signed 64-bit number."""
    hashes = shingle_hashes(text, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, n: int = SHINGLE) -> Column:
    """The SimHash of a text column as a long."""

    @arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([simhash(t.as_py(), n) for t in texts], pa.int64())

    return fingerprints(text)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def agreement_masks(radius: int, parts: int) -> list[int]:
    """Masks of ``parts - radius`` parts each: values within the radius agree under at least one mask."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in c) for c in itertools.combinations(range(parts), parts - radius)]


def choose_masks(distinct: int, radius: int) -> list[int]:
    """The mask set with the lowest estimated cost; any choice gives the same pairs."""
    if radius >= BITS:
        return [0]

    def cost(parts: int) -> float:
        copies, bits = math.comb(parts, radius), BITS * (parts - radius) / parts
        return copies * distinct * 3e-6 + copies * distinct**2 / 2**bits * 1e-9

    options = range(radius + 1, min(BITS, radius + 5) + 1)
    return agreement_masks(radius, min(options, key=cost))


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` points is connected to."""
    labels = np.arange(n)
    while True:
        before = labels.copy()
        low = np.minimum(labels[i], labels[j])
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def compare_tiles(left: np.ndarray, right: np.ndarray | None, mask: int, earlier: np.ndarray, radius: int):
    """Pairs within the radius, as a star per connected set; ``right`` None compares a tile with itself.

    A pair that agrees under an earlier mask was seen there and is left out.
    """
    points = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(points), bool)
    side[len(left) :] = True
    order = np.argsort(np.bitwise_count(points), kind="stable")
    points, side = points[order], side[order]
    counts = np.bitwise_count(points).astype(np.int64)
    found_i, found_j = [], []
    for a in range(0, len(points), BLOCK):
        x = points[a : a + BLOCK]
        for b in range(a, len(points), BLOCK):
            if counts[b] - counts[a + len(x) - 1] > radius:
                break  # blocks go up by population count
            distance = np.bitwise_xor(x[:, None], points[None, b : b + BLOCK])
            i, j = np.nonzero(np.bitwise_count(distance) <= radius)
            keep = (i + a < j + b) if right is None else ((i + a < j + b) & (side[i + a] != side[j + b]))
            i, j = i[keep], j[keep]
            for other in earlier:
                fresh = (distance[i, j] & other) != 0
                i, j = i[fresh], j[fresh]
            found_i.append(i + a)
            found_j.append(j + b)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return points[:0], points[:0]
    labels = _labels(len(points), i, j)
    member = np.flatnonzero(labels != np.arange(len(points)))
    return points[member], points[labels[member]]


def _tiles(distinct: DataFrame, masks: list[int], tile: int) -> DataFrame:
    """One row per tile: ``combo, value, tile, lo, hi`` (population counts) and ``fps``."""
    keys = F.array(*[
        F.struct(F.lit(c).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for c, m in enumerate(masks)
    ])
    keyed = distinct.select("fp", F.bit_count("fp").alias("ones"), F.explode(keys).alias("k")).select("k.*", "fp", "ones")
    crowded = materialize(
        keyed.groupBy("combo", "value").count().filter(F.col("count") > tile).select("combo", "value"), "crowded"
    )
    if crowded.isEmpty():
        cut = keyed.withColumn("tile", F.lit(""))
    else:
        # A crowded set is cut by population count, and a count with too many members by hash.
        crowded = small(crowded)
        inside = keyed.join(crowded, ["combo", "value"], "left_semi")
        cuts = inside.groupBy("combo", "value", "ones").agg(F.ceil(F.count("*") / tile).alias("cuts"))
        number = F.concat_ws("-", "ones", F.pmod(F.xxhash64("fp"), F.col("cuts")))
        inside = inside.join(small(materialize(cuts, "cuts")), ["combo", "value", "ones"])
        cut = keyed.join(crowded, ["combo", "value"], "left_anti").withColumn("tile", F.lit("")).unionByName(
            inside.withColumn("tile", number).drop("cuts")
        )
    grouped = cut.groupBy("combo", "value", "tile").agg(
        F.min("ones").alias("lo"), F.max("ones").alias("hi"), F.collect_list("fp").alias("fps")
    )
    return grouped.filter("tile != '' OR size(fps) > 1")


def near_edges(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fp`` exactly as all pairs within the radius would."""
    masks = choose_masks(distinct.count(), radius)
    unsigned = np.array(masks, np.uint64)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            two = "other" in batch.schema.names
            for k, combo in enumerate(batch.column("combo").to_pylist()):
                left = batch.column("fps")[k].values.to_numpy().view(np.uint64)
                right = batch.column("other")[k].values.to_numpy().view(np.uint64) if two else None
                a, b = compare_tiles(left, right, masks[combo], unsigned[:combo], radius)
                out_a.append(a)
                out_b.append(b)
            a, b = (np.concatenate(x).view(np.int64) for x in (out_a, out_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    tiles = materialize(_tiles(distinct, masks, tile), "tiles")
    edges = tiles.filter("size(fps) > 1").select("combo", "fps").mapInArrow(stars, "a long, b long")
    key = ["combo", "value", "tile"]
    directory = tiles.filter("tile != ''").select(*key, "lo", "hi")
    if not directory.isEmpty():
        other = directory.select("combo", "value", *[F.col(c).alias(f"{c}2") for c in ("tile", "lo", "hi")])
        near = F.expr(f"tile < tile2 AND lo - hi2 <= {radius} AND lo2 - hi <= {radius}")
        pairs = directory.join(other, ["combo", "value"]).filter(near).select(*key, "tile2")
        right = tiles.select("combo", "value", F.col("tile").alias("tile2"), F.col("fps").alias("other"))
        both = pairs.join(tiles.select(*key, "fps"), key).join(right, ["combo", "value", "tile2"])
        edges = edges.union(both.select("combo", "fps", "other").mapInArrow(stars, "a long, b long"))
    return materialize(edges.distinct(), "edges")


def simhash_groups(rows: DataFrame, id_column: str, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(id, fp, component_id)`` per row of ``rows``, which has ``fp``; the component's id is its smallest id.

    Fingerprint zero (no words) links like any other. Null ids are passed over by the minimum; a component with
    null ids only has a null id. Repeated rows stay repeated.
    """
    distinct = materialize(rows.groupBy("fp").agg(F.min(id_column).alias("first")), "distinct")
    roots = components(near_edges(distinct.select("fp"), radius, tile))
    placed = distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # A component may hold most fingerprints: its members look up one small row each.
    members = materialize(placed.join(small(materialize(least, "least")), "root").select("fp", "component_id"), "members")
    return rows.select(id_column, "fp").join(small(members), "fp", "left")


def keep_first(
    docs: DataFrame, text: str = "text", order: tuple[str, ...] = (), n: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` with one row left of each near-duplicate group.

    The first by the ``order`` columns (nulls last) stays, then the first as read. All columns are kept as they are.
    """
    rid = free_name(docs, "rid")
    numbered = with_row_ids(docs, "numbered", rid)
    place = [x for c in order for x in (named(c).isNull(), named(c))]
    key = F.struct(*[x.alias(f"k{i}") for i, x in enumerate([*place, named(rid)])])
    prints = numbered.select(key.alias("key"), fingerprint(named(text), n).alias("fp"))
    groups = simhash_groups(materialize(prints, "prints"), "key", radius)
    last = F.col(f"key.k{len(place)}")
    gone = materialize(groups.filter("key != component_id").select(last.alias(rid)), "gone")
    return numbered.join(small(gone), rid, "left_anti").select(*[named(c) for c in docs.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents")
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "prints")
    groups = simhash_groups(prints, "doc_id")
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
