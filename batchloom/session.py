"""Session settings the operators rely on, and the shared folder for written intermediate tables."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession

# JSON objects may repeat a key: the last one wins, as the wire format's decoder does.
# Event times are epoch milliseconds, so every derived timestamp is read in UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The size of a missing list is NULL, with ANSI mode on or off.
    "spark.sql.legacy.sizeOfNull": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; call before building any plan from this package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a fresh temporary folder: on a cluster a machine-local folder
    would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_scratch(spark.sparkContext.applicationId)


@functools.cache
def _local_scratch(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"batchloom-{application_id}-")


def checkpointed(df):
    """Write ``df`` to the shared folder and go on from the written copy."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark) + "/checkpoints")
    return df.checkpoint(eager=True)
