"""Vector code compression: product codes trained by k-means that skips distances with norm-of-sum bounds.

Vectors are cut into parts, each part has a codebook, and a code names the nearest entry per part. Each round assigns
every part to its nearest entry and moves every entry to the mean of its parts. Components are integers and so are
squared distances, so results don't depend on the order in which rows are read.

*Bounds.* Each part of each vector keeps an upper bound of the distance to its entry, and for every group of entries a
lower bound of the distance to all others in the group. A bound is not touched until it fails: it keeps the value it had
when it was exact, stamped with the round of that time. The codebooks of all rounds are retained, so in a later round
the entries' true net displacement since the stamp (the norm of the sum of their moves) is known, and

    upper = distance then + |entry now - entry then|     lower = distance then - most of |entry now - entry then|

which is tighter than adding up the lengths of the moves, since entries also move back. Only groups whose lower bound
does not exceed the upper one are measured again, with exact integer distances; ties go to the smaller index, so a group
is skipped only where its bound is greater.

*Layout.* Bounds lie beside the vectors in a table written per round; the table of the round before is deleted then.
Codebooks, of ``entries`` times the dimension numbers, and the displacements since each round are sent to all tasks.
Means are exact: each task adds up integers per entry, and one row per component of an entry reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import materialize, named, remove, table
from batchloom.operators.spread import lookup_join

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Consecutive entries that share one lower bound.
GROUP = 32
#: Bounds count as equal when they differ by less: by so much of their size, and this at least.
SLACK = 1e-9


@dataclass
class Codebooks:
    """Entries of every part after each round: ``history[t]`` is ``[part, entry, component]``."""

    history: list[np.ndarray] = field(default_factory=list)

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def displacements(self) -> np.ndarray:
        """``[round, part, entry]``: how far entries are now from where they were after each round."""
        now = self.last.astype(np.float64)
        return np.stack([np.sqrt(((now - then) ** 2).sum(axis=2)) for then in self.history])

    def digest(self) -> str:
        """Hex digest of all components by part, entry and position, joined by commas."""
        numbers = ",".join(map(str, self.last.ravel().tolist()))
        return hashlib.sha256(numbers.encode()).hexdigest()


@dataclass
class Bounds:
    """State of one part of many vectors; distances are rounded away from the truth, never towards it."""

    code: np.ndarray
    upper: np.ndarray
    upper_at: np.ndarray
    lower: np.ndarray
    lower_at: np.ndarray

    @classmethod
    def none(cls, rows: int, groups: int) -> Bounds:
        return cls(
            np.zeros(rows, np.int64), np.full(rows, np.inf), np.zeros(rows, np.int64),
            np.zeros((rows, groups)), np.zeros((rows, groups), np.int64),
        )


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and ``y``, both whole numbers within ``most``."""
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, state: Bounds) -> tuple[Bounds, int]:
    """Nearest entry of each row of ``x`` (floats that are whole numbers), and the number of distances measured.

    ``moved[t]`` is how far each entry is now from where it was in round ``t``; the last row is zero. ``state`` is
    changed in place.
    """
    now, k = len(moved) - 1, len(entries)
    starts = np.arange(0, k, GROUP)
    furthest = np.maximum.reduceat(moved, starts, axis=1)  # [round, group]
    lower = state.lower - furthest[state.lower_at, np.arange(len(starts))]
    upper = state.upper + moved[state.upper_at, state.code]
    measured = 0

    def may_be_nearer(rows: np.ndarray) -> np.ndarray:
        return lower[rows] <= upper[rows, None] + SLACK * (1.0 + upper[rows, None])

    open_rows = np.flatnonzero(may_be_nearer(np.arange(len(x))).any(axis=1))
    if not len(open_rows):
        return state, measured
    # The distance to the own entry first: an exact upper bound often settles the row.
    own = ((x[open_rows] - entries[state.code[open_rows]]) ** 2).sum(axis=1)
    measured += len(open_rows)
    state.upper[open_rows], state.upper_at[open_rows] = np.sqrt(own), now
    upper[open_rows] = state.upper[open_rows]
    still = may_be_nearer(open_rows)
    some = still.any(axis=1)
    rows, still, own = open_rows[some], still[some], own[some]
    if not len(rows):
        return state, measured

    old = state.code[rows]
    best, best_square = old.copy(), own.copy()
    least = np.full((len(rows), len(starts), 2), np.inf)  # the two smallest squares of each measured group
    place = np.full((len(rows), len(starts)), -1)
    for g, first in enumerate(starts.tolist()):
        at = np.flatnonzero(still[:, g])
        if not len(at):
            continue
        squares = _squares(x[rows[at]], entries[first : first + GROUP])
        measured += squares.size
        nearest = squares.argmin(axis=1)  # the smallest index of equals
        near = squares[np.arange(len(at)), nearest]
        least[at, g, 0], place[at, g] = near, first + nearest
        if squares.shape[1] > 1:
            squares[np.arange(len(at)), nearest] = np.inf
            least[at, g, 1] = squares.min(axis=1)
        better = (near < best_square[at]) | ((near == best_square[at]) & (first + nearest < best[at]))
        best[at[better]], best_square[at[better]] = first + nearest[better], near[better]
    # Measured groups have exact bounds over their entries but the chosen one.
    others = np.where(place == best[:, None], least[:, :, 1], least[:, :, 0])
    r, g = np.nonzero(still)
    state.lower[rows[r], g], state.lower_at[rows[r], g] = np.sqrt(others[r, g]), now
    # The entry that was left counts among the others of its group, also where that was not measured.
    left = np.flatnonzero((best != old) & ~still[np.arange(len(rows)), old // GROUP])
    whose, group = rows[left], old[left] // GROUP
    state.lower[whose, group] = np.minimum(np.maximum(lower[whose, group], 0.0), np.sqrt(own[left]))
    state.lower_at[whose, group] = now
    state.code[rows], state.upper[rows], state.upper_at[rows] = best, np.sqrt(best_square), now
    return state, measured


def most(width: int) -> int:
    """Scaled components up to this have exact squared distances in floating point, over ``width`` components."""
    return 1 << (51 - (width - 1).bit_length()) // 2


# Tables


_STATE = "codes binary, bounds binary, stamps binary"


def _pack(states: list[Bounds]) -> list[list[bytes]]:
    """Codes, bounds and stamps of all parts of each row; bounds as four-byte floats that keep them bounds."""
    codes = np.stack([s.code for s in states], axis=1).astype(np.uint8)
    upper = np.stack([s.upper for s in states], axis=1)
    lower = np.stack([s.lower for s in states], axis=1)
    up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
    down = np.nextafter(np.minimum(lower, 3e38).astype(np.float32), np.float32(-np.inf))
    rows = len(codes)
    bounds = np.concatenate([up[:, :, None], down], axis=2).reshape(rows, -1)
    stamps = np.concatenate([np.stack([s.upper_at for s in states], axis=1)[:, :, None],
                             np.stack([s.lower_at for s in states], axis=1)], axis=2)
    stamps = stamps.astype(np.uint8).reshape(rows, -1)
    return [[r.tobytes() for r in block] for block in (codes, bounds, stamps)]


def _unpack(batch: pa.RecordBatch, parts: int, groups: int) -> list[Bounds]:
    rows = batch.num_rows

    def block(name: str, kind, width: int) -> np.ndarray:
        joined = b"".join(v.as_py() for v in batch.column(batch.schema.get_field_index(name)))
        return np.frombuffer(joined, kind).reshape(rows, parts, width)

    codes, bounds = block("codes", np.uint8, 1), block("bounds", np.float32, 1 + groups)
    stamps = block("stamps", np.uint8, 1 + groups)
    return [
        Bounds(
            codes[:, p, 0].astype(np.int64), bounds[:, p, 0].astype(np.float64), stamps[:, p, 0].astype(np.int64),
            bounds[:, p, 1:].astype(np.float64), stamps[:, p, 1:].astype(np.int64),
        )
        for p in range(parts)
    ]


def scaled(vectors: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows whose ``vector`` is whole and finite, with it as integers ``floor(scale * x)`` in ``v``."""
    x = named(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return kept.withColumn("v", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _parts(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """``[row, part, component]`` of the column ``v``."""
    column = batch.column(batch.schema.get_field_index("v"))
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    whole = np.zeros((len(column), parts * width))
    whole[:, : flat.shape[1]] = flat
    return whole.reshape(len(column), parts, width)


def _assigned(rows: DataFrame, books: Codebooks, name: str) -> DataFrame:
    """A written copy of ``rows`` with the state of this round."""
    parts, k, width = books.last.shape
    groups = -(-k // GROUP)
    entries, moved = books.last.astype(np.float64), books.displacements()
    started = "codes" in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch, parts, width)
            states = _unpack(batch, parts, groups) if started else [Bounds.none(len(x), groups) for _ in range(parts)]
            for p in range(parts):
                assign(x[:, p], entries[p], moved[:, p], states[p])
            chosen = np.stack([entries[p][states[p].code] for p in range(parts)], axis=1)
            error = ((x - chosen) ** 2).sum(axis=(1, 2)).astype(np.int64)
            arrays = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for n, block in zip(("codes", "bounds", "stamps"), _pack(states)):
                arrays[n] = pa.array(block, pa.binary())
            arrays["error"] = pa.array(error)
            yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names)

    names = ["id", "label", "v", "codes", "bounds", "stamps", "error"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, v array<long>, {_STATE}, error long"
    return materialize(rows.mapInArrow(work, schema), name)


def _means(assigned: DataFrame, books: Codebooks) -> np.ndarray:
    """New entries: floor of the mean of the parts assigned to each; entries without any stay."""
    parts, k, width = books.last.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch, parts, width).astype(np.int64)
            codes = np.frombuffer(b"".join(c.as_py() for c in batch.column(1)), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=k)
        part, entry = np.nonzero(counts)
        columns = [
            np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)),
            sums[part, entry].ravel(), np.repeat(counts[part, entry], width),
        ]
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "at", "s", "n"])

    sums = assigned.select("v", "codes").mapInArrow(add, "part int, entry int, at int, s long, n long")
    exact = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")  # beyond 64 bits with very many rows
    entries = books.last.copy()
    for r in sums.groupBy("part", "entry", "at").agg(exact, F.sum("n").alias("n")).toLocalIterator():
        entries[r.part, r.entry, r["at"]] = int(r.s) // r.n
    return entries


def train_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """``(id, label, v, codes, error, ...)`` of every kept row as a written table, and the codebooks of all rounds.

    Rows are left out whose vector is null, empty, or holds null or non-finite components, or has another length than
    that of the smallest key. The codebooks start with the parts of the ``entries`` smallest keys, null keys last, equal keys
    by vector. Parts are equal: where the length is no multiple of ``parts``, the last one is filled up with zeros.
    Components beyond ``most`` once scaled (8,192 for 16 components a part) are refused: their distances would not be exact.
    """
    rows = scaled(vectors.select(named(key).alias("id"), named(label).alias("label"), named(vector).alias("x")), "x", scale)
    rows = rows.filter(F.size("v") > 0).select("id", "label", "v")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    length = first.select(F.size("v").alias("d")).first()
    if length is None:
        nothing = {"codes": F.lit(b""), "error": F.lit(0).cast("long")}
        return rows.limit(0).withColumns(nothing), Codebooks([np.zeros((parts, 0, 0), np.int64)])
    rows = rows.filter(F.size("v") == length.d)
    start = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    width = -(-length.d // parts)
    limit = most(width)
    if not rows.filter(F.exists("v", lambda c: (c > limit) | (c < -limit))).isEmpty():
        raise ValueError(f"components must lie within {limit / scale:g}")
    whole = np.zeros((len(start), parts * width), np.int64)
    whole[:, : length.d] = start
    books = Codebooks([np.ascontiguousarray(whole.reshape(len(start), parts, width).transpose(1, 0, 2))])
    assigned = _assigned(rows, books, "codes")
    for _ in range(rounds):
        books.history.append(_means(assigned, books))
        before, assigned = assigned, _assigned(assigned.drop("error"), books, "codes")
        remove(before)
    return assigned, books


def coded(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options
) -> DataFrame:
    """Key, ``code`` in hex, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept row; see ``train_codes``."""
    assigned, books = train_codes(vectors, key, vector, label, **options)
    found = assigned.select("id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    marked = found.withColumns({"_null": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = materialize(marked.groupBy("_null", "_label").agg(F.sum("error").alias("label_error")), "label-errors")
    joined = lookup_join(marked, sums, ["_null", "_label"], F.col("code"))
    return joined.select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def op11_norm_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings."""
    return coded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _sql(rounds: int = ROUNDS) -> str:
    entry = "list_inner_product(c::DOUBLE[], c::DOUBLE[])"
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT rid, p, x, min((xx - 2 * list_inner_product(xd, cd) + cc)::BIGINT * 256 + e) AS near
  FROM parts JOIN (SELECT p, e, c::DOUBLE[] AS cd, {entry} AS cc FROM c{t}) USING (p) GROUP BY rid, p, x
)""")
        if t < rounds:
            steps.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM c{t} LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT p, near % 256 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
      FROM (SELECT p, near, x, unnest(range(1, len(x) + 1)) AS i FROM a{t}) GROUP BY ALL
    ) GROUP BY p, e
  ) USING (p, e)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
),
parts AS MATERIALIZED (
  SELECT rid, p, x, x::DOUBLE[] AS xd, list_inner_product(x::DOUBLE[], x::DOUBLE[]) AS xx FROM (
    SELECT rid, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x FROM (
      SELECT rid, v, unnest(range({PARTS})) AS p FROM kept
    )
  )
),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= {ENTRIES}),{",".join(steps)},
books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}
),
coded AS (
  SELECT rid, string_agg(lower(printf('%02x', (near % 256)::INTEGER)), '' ORDER BY p) AS code,
    sum(near // 256)::BIGINT AS error
  FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), books
"""


OP11_SQL = _sql()
