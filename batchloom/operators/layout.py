"""Where stored rows lie: event days, cells of a space-filling curve, and buckets of batch ids.

The functions that place a row also give the filters that find it again. Filters are plain predicates over stored
columns with constant right sides, so Spark prunes folders and row groups with them; they only narrow, the exact
predicate stays beside them.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Days from 1970 to the end of 2099 are folders of their own; all other times share one.
DAYS = 47_482
OTHER_DAY = -1

#: Columns of the curve, most significant bit first, and bits of each.
CURVE = ("project_id", "org_id", "user_id")
BITS = 2


def event_day(timestamp_ms: Column) -> Column:
    """Number of the day since 1970, or ``OTHER_DAY``: times are client data, and each day is a folder."""
    day = F.floor(timestamp_ms / DAY_MS)
    return F.when(day.between(0, DAYS - 1), day).otherwise(OTHER_DAY).cast("int")


def in_days(start_ms: int | None, end_ms: int | None) -> Column:
    """The folders that may hold times from ``start_ms`` to ``end_ms``; ``None`` leaves a side open."""
    day, found = F.col("event_day"), F.lit(True)
    if start_ms is not None:
        found = found & (day >= max(0, min(start_ms // DAY_MS, DAYS)))
    if end_ms is not None:
        found = found & (day < max(0, min(end_ms // DAY_MS + 1, DAYS)))
    beyond = start_ms is None or end_ms is None or start_ms < 0 or end_ms >= DAYS * DAY_MS
    return found | (day == OTHER_DAY) if beyond else found


def _place(column: Column) -> Column:
    """``BITS`` bits of a value's hash."""
    return F.pmod(F.xxhash64(column), F.lit(1 << BITS)).cast("int")


def _shifts(name: str) -> list[int]:
    """Where the bits of a column are in a cell number, highest first: one bit of every column in turn."""
    n = len(CURVE)
    return [n * bit + n - 1 - CURVE.index(name) for bit in reversed(range(BITS))]


def _spread(place: Column, name: str) -> Column:
    bits = [
        F.shiftleft(F.shiftright(place, BITS - 1 - i).bitwiseAND(1), shift) for i, shift in enumerate(_shifts(name))
    ]
    return reduce(lambda a, b: a + b, bits)


def cell() -> Column:
    """Cell of an event on the curve: rows that share a project, an organization or a user lie in few runs of cells."""
    return reduce(lambda a, b: a + b, [_spread(_place(F.col(c)), c) for c in CURVE])


def in_cells(**values: str) -> Column:
    """The runs of cells that hold the given values of columns of the curve."""
    fixed = [s for name in values for s in _shifts(name)]
    free = [s for s in range(BITS * len(CURVE)) if s not in fixed and s > min(fixed)]
    base = reduce(lambda a, b: a + b, [_spread(_place(F.lit(v)), name) for name, v in values.items()])
    length = 1 << min(fixed)
    found = []
    for bits in product((0, 1), repeat=len(free)):
        start = base + sum(bit << shift for bit, shift in zip(bits, free))
        found.append((F.col("cell") >= start) & (F.col("cell") < start + length))
    return reduce(lambda a, b: a | b, found)


def bucket(batch_id: Column, buckets: int) -> Column:
    """The number Spark itself gives a row of a table bucketed by this column."""
    return F.pmod(F.hash(batch_id), F.lit(buckets)).cast("int")
