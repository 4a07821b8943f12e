"""A Bloom filter over the keys of a table, built with the bitmap aggregates, that keeps rows out of a shuffle.

The filter is a table of ``BLOCKS`` blocks of 32,768 bits. Each key belongs to one block and sets ``BITS`` bits there, so
one broadcast join finds them all. It is 16 MB however many keys there are; with very many it lets everything pass, and
then costs a scan and saves nothing. Rows that it keeps out are certainly not in the table; the others may be, and an
exact join decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 4 KB.
BLOCKS = 4_096
BLOCK_BITS = 32_768
#: Bits per key; at ten bits of room a key, about one other key in 100 passes.
BITS = 4


def _block(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), *keys), F.lit(BLOCKS)).cast("int")


def _places(keys: Sequence[str]) -> list[Column]:
    """Bits inside the block: 15 bits each of one hash."""
    h = F.xxhash64(F.lit("bits"), *keys)
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(BITS)]


def bloom_filter(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(block, bits)`` over the keys of ``rows``; a task sends one bitmap per block, however many rows it has."""
    bits = rows.select(_block(keys).alias("block"), F.explode(F.array(*_places(keys))).alias("at"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1


def may_be_in(rows: DataFrame, bloom: DataFrame, keys: Sequence[str], name: str = "maybe") -> DataFrame:
    """Add ``name``: false only for rows whose key is certainly not in the filter; rows don't move."""
    joined = rows.withColumn("_block", _block(keys)).join(
        F.broadcast(bloom.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block", "left"
    )
    found = reduce(lambda a, b: a & b, [_is_set(F.col("_bits"), place) for place in _places(keys)])
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("_block", "_bits")


def anti_join(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``known``; only those that may be known are shuffled.

    Null keys are in no table. ``rows`` and ``known`` must be cheap to read twice.
    """
    keys = list(keys)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    marked = may_be_in(rows, bloom_filter(known.filter(whole).select(*keys), keys), keys)
    fresh = marked.filter(~F.col("maybe")).drop("maybe")
    open_rows = marked.filter("maybe").drop("maybe")
    return fresh.unionByName(open_rows.join(known.select(*keys).hint("merge"), keys, "left_anti"))
