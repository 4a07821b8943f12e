"""Helpers shared by the operators: written intermediate tables, checked broadcasts, global order, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.session import shared_dir

#: A side may be broadcast up to this many rows and bytes; both are counted first.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: ``[^\x20\x09-\x0D]+``, the words of most contracts, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy, which no lost executor can take away."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(written: DataFrame) -> None:
    """Delete the files of a ``materialize`` that no frame reads any more."""
    spark = written.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def named(column: str) -> Column:
    """A column by its exact name, also one with dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``rows`` rows and ``size`` bytes; reads no more than that many rows."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        long = isinstance(field.dataType, (T.StringType, T.BinaryType))
        width = width + (F.coalesce(F.octet_length(named(field.name)), F.lit(0)) + 16 if long else F.lit(16))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to fit; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df) else df


def in_order(df: DataFrame, keys: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` sorted by ``keys``, nulls last, written with one range per task; ``shard`` numbers the ranges in order.

    Add a row number to the keys to split a hot key over several ranges.
    """
    order = [k.asc_nulls_last() for k in keys]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return materialize(ranged.sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id()), name)


def with_row_ids(df: DataFrame, name: str, column: str = "rid") -> DataFrame:
    """A written copy of ``df`` with a unique number per row, the same in every later read."""
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name)


def _fold(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on undirected edges ``(a, b)``; both keep connectivity."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` per vertex of ``edges`` that is not the smallest of its component; ``b`` is the smallest.

    Alternating star contraction: a few rounds, each written to the shared folder. Every step reduces to a
    minimum per vertex (partial aggregation) and joins it back, so a vertex with very many edges is a skewed
    join that adaptive execution splits.
    """
    state, edges = None, edges.filter("a != b").select("a", "b")
    while True:
        edges = materialize(_fold(edges), "stars")
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] == 0 or (found["n"], found["h"]) == state:
            return edges
        state = (found["n"], found["h"])
