"""Worker log lines as text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions import logfields


def read_worker_log(spark: SparkSession, path: str, partitions: str = "") -> DataFrame:
    """Lines as ``value``, plus the columns of a partitioned folder; a missing path gives no lines.

    ``partitions`` names those columns with their types (``run_id string``), so that a missing log has them too.
    """
    schema = f"value string, {partitions}" if partitions else "value string"
    try:
        return spark.read.schema(schema).option("lineSep", "\n").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def log_fields(lines: DataFrame, *keys: str) -> DataFrame:
    line = F.col("value")
    return lines.select(
        *keys,
        logfields.log_time(line).alias("ts"),
        logfields.worker_id(line).alias("worker_id"),
        F.nullif(F.regexp_extract(line, 'msg="([^"]*)"', 1), F.lit("")).alias("msg"),
    )
