"""Joining many rows to a lookup that has one row per key, when a few keys may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
ROWS_PER_SALT = 1_000_000


def size_columns(df: DataFrame) -> list[Column]:
    """Aggregates ``n`` and ``b``: rows and bytes of ``df``. Text is counted by its bytes: keys may have any length."""
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")]


def is_small(size: dict, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    return size["n"] <= max_rows and size["b"] <= max_bytes


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has few enough rows and bytes; reads no more than that many rows."""
    return is_small(df.limit(max_rows + 1).agg(*size_columns(df)).first().asDict(), max_rows, max_bytes)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    condition: Column | None = None,
    weights: DataFrame | None = None,
    max_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup`` on ``keys``; the lookup must be cheap to read twice (a written table).

    A small lookup is broadcast and ``rows`` does not move. Otherwise both sides are shuffled, and every key with
    more than ``ROWS_PER_SALT`` rows is spread over one partition per that many. Such keys are at most the rows
    divided by ``ROWS_PER_SALT``; their table is broadcast when it fits, else shuffled. ``weights`` holds the number
    of rows per key as ``n`` where that is known already, and ``small`` says whether the lookup fits a broadcast where
    it was counted already. ``condition`` narrows an inner join.
    """
    keys = list(keys)
    if fits_broadcast(lookup, max_rows) if small is None else small:
        joined = rows.join(F.broadcast(lookup), keys, how)
        return joined if condition is None else joined.filter(condition)
    if weights is None:
        weights = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("_salts")
    hot = weights.filter(F.col("n") > ROWS_PER_SALT).select(*keys, salts)
    hot = F.broadcast(hot) if fits_broadcast(hot, max_rows) else hot
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int"), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    salted_rows = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    salted_lookup = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    joined = salted_rows.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")
    return joined if condition is None else joined.filter(condition)
