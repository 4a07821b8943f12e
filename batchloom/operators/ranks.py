"""Exact values at given ranks of a very long list, per group, without sorting the list.

``value_at_rank`` narrows a bracket around each wanted rank: it counts values per bucket (partial aggregation
before the shuffle), finds the bucket that holds the rank, and looks only at that bucket in the next pass.
The first pass uses buckets of equal ratio, so long tails do not matter; later passes cut the bracket into
equal parts. Every shuffled row is a bucket count: a group has a bounded number of them, however many values
it holds, so one hot group never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.spread import fits_broadcast, lookup_join
from batchloom.session import checkpointed

PER_OCTAVE = 16
PARTS = 1_048_576
_ABOVE_ANY_EXPONENT = 1_100 * PER_OCTAVE


def _ratio_bucket(value: Column) -> Column:
    """Order-preserving bucket number; zero is alone in bucket 0, negative values mirror positive ones."""
    size = F.floor(F.log2(F.abs(value)) * PER_OCTAVE) + _ABOVE_ANY_EXPONENT
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _part(value: Column) -> Column:
    width = F.col("hi") - F.col("lo")
    return F.when(width > 0, F.floor((value - F.col("lo")) / width * PARTS)).otherwise(0)


def _holding_bucket(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket each rank falls in, with the rank counted from that bucket's start."""
    upto = Window.partitionBy(*keys, "ratio").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (
        histogram.withColumn("upto", F.sum("n").over(upto))
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select(
            *keys, "ratio", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"),
            F.col("low").alias("lo"), F.col("high").alias("hi"),
        )
    )


def value_at_rank(rows: DataFrame, keys: list[str], value: str, ratios: list[float]) -> DataFrame:
    """Per group: ``n``, ``low``, ``high`` and, as ``ratio -> value``, the value at index
    ``trunc((n - 1) * ratio)`` of the sorted values. No interpolation.

    NULL, NaN and infinite values are no measurements: they are left out of all results.
    """
    values = rows.select(*keys, F.col(value).cast("double").alias("v"))
    values = values.filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    coarse = checkpointed(
        values.withColumn("bucket", _ratio_bucket(F.col("v")))
        .groupBy(*keys, "bucket")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    totals = coarse.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    wanted = totals.select(*keys, F.explode(F.array(*map(F.lit, ratios))).alias("ratio"), "n").select(
        *keys, "ratio", F.floor((F.col("n") - 1) * F.col("ratio")).alias("rank")
    )
    brackets = checkpointed(_holding_bucket(coarse.join(wanted, keys), keys))
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    weights = totals.select(*keys, "n")
    found = brackets.filter("lo = hi")
    open_brackets = brackets.filter("lo < hi")
    while not open_brackets.isEmpty():
        if fits_broadcast(open_brackets):
            counted = values.withColumn("count", F.lit(1))
        else:
            # The values will be shuffled: equal ones first become one row, or a common value would be hot.
            counted = values.groupBy(*keys, "v").count()
        parts = (
            lookup_join(counted, open_brackets, keys, F.col("v"), condition=inside, weights=weights)
            .withColumn("bucket", _part(F.col("v")))
            .groupBy(*keys, "ratio", "rank", "bucket")
            .agg(F.sum("count").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        )
        before, brackets = open_brackets, checkpointed(_holding_bucket(parts, keys))
        same = [*keys, "ratio", "lo", "hi"]
        if not brackets.filter("lo < hi").join(before.select(*same), same, "left_semi").isEmpty():
            raise ArithmeticError("a pass did not narrow the bracket of a rank")
        found = found.unionByName(brackets.filter("lo = hi"))
        open_brackets = brackets.filter("lo < hi")
    by_ratio = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("ratio") == r, F.col("lo"))).alias(_ratio_name(r)) for r in ratios]
    )
    return totals.join(by_ratio, keys)


def _ratio_name(ratio: float) -> str:
    return f"p{round(ratio * 100)}"
