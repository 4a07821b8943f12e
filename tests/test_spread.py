import pytest
from pyspark.sql import functions as F

from batchloom.operators import spread
from batchloom.operators.spread import lookup_join


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("max_rows", [0, 1000])
def test_lookup_join_matches_a_plain_join(spark, monkeypatch, how, max_rows):
    monkeypatch.setattr(spread, "ROWS_PER_SALT", 100)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 40).alias("key"))
    lookup = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    joined = lookup_join(rows, lookup, ["key"], F.col("id"), how, max_rows=max_rows)
    plain = rows.join(lookup, "key", how)
    assert joined.columns == plain.columns
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
