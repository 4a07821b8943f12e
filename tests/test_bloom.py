"""Rows kept out of a shuffle are certainly new, and results are exact."""

import json

from pyspark.sql import functions as F

from batchloom.operators import bloom


def _keys(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("b"), "id").alias("batch_id"), (F.col("id") % 7).cast("int").alias("event_index"))


KEYS = ["batch_id", "event_index"]


def test_no_key_is_missed_and_few_others_pass(spark):
    known = _keys(spark, 0, 50_000)
    table = bloom.bloom_filter(known, KEYS)
    assert bloom.may_be_in(known, table, KEYS).filter(~F.col("maybe")).isEmpty()
    others = bloom.may_be_in(_keys(spark, 50_000, 150_000), table, KEYS)
    assert others.columns == [*KEYS, "maybe"] and others.filter("maybe").count() < 100


def test_anti_join_is_exact(spark, monkeypatch):
    """Also with a filter that is nearly full, with nulls, with copies, and with empty sides."""
    for blocks in (bloom.BLOCKS, 1):
        monkeypatch.setattr(bloom, "BLOCKS", blocks)
        nulls = spark.createDataFrame([(None, 1), ("b3", None), (None, None), ("b3", 3), ("b3", 3)], "batch_id string, event_index int")
        rows = _keys(spark, 20_000, 60_000).unionByName(nulls)
        known = _keys(spark, 0, 40_000).unionByName(nulls.limit(3))
        found = bloom.anti_join(rows, known, KEYS)
        plain = rows.join(known, KEYS, "left_anti")
        assert found.columns == rows.columns
        assert found.count() == plain.count() == 20_003
        assert found.exceptAll(plain).isEmpty()
        assert bloom.anti_join(rows, known.limit(0), KEYS).count() == rows.count()
        assert bloom.anti_join(rows.limit(0), known, KEYS).isEmpty()


def test_new_rows_are_not_shuffled(spark, tmp_path):
    """Rows written to the shuffles of the rows' side: those that may be known, not all."""
    _keys(spark, 0, 200_000).write.parquet(str(tmp_path / "known"))
    _keys(spark, 199_000, 400_000).write.parquet(str(tmp_path / "rows"))
    known, rows = spark.read.parquet(str(tmp_path / "known")), spark.read.parquet(str(tmp_path / "rows"))
    found = bloom.anti_join(rows, known, KEYS)
    assert found.count() == 200_000
    found.collect()
    written = json.dumps(_shuffled(found._jdf.queryExecution().executedPlan()))
    rows_side = [n for name, n in json.loads(written) if "event_index" in name and "bits" not in name]
    assert min(rows_side) < 5_000


def _shuffled(plan):
    """Output columns and rows written of every shuffle."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    found = [x for child in children for x in _shuffled(child)]
    if name == "ShuffleExchangeExec":
        found.append((plan.output().mkString(","), plan.metrics().apply("shuffleRecordsWritten").value()))
    return found
