"""Tables the registered queries share: landed messages, the ingested store, logs and reports.

Each is derived once per session and input folder, and written below the shared folder.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.runs import run_report, worker_counts_of_runs
from batchloom.plans import inputs
from batchloom.session import configure, shared_dir
from batchloom.sources.messages import read_batch_messages, stream_batch_messages
from batchloom.sources.reports import read_run_reports, write_run_reports
from batchloom.sources.store import EventStore
from batchloom.sources.worker_log import read_worker_log
from batchloom.streaming.ingest import drain, prepare, process_epoch


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self.root = f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex}"

    def fresh(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def _written(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @functools.cached_property
    def messages_path(self) -> str:
        path = f"{self.root}/messages"
        inputs.build_messages(self.spark, self.sf_dir).write.json(path)
        return path

    @property
    def messages(self) -> DataFrame:
        return read_batch_messages(self.spark, self.messages_path)

    @property
    def message_stream(self) -> DataFrame:
        return stream_batch_messages(self.spark, self.messages_path)

    @functools.cached_property
    def accepted(self) -> DataFrame:
        """Hash of every accepted message."""
        prepared = prepare(self.messages).filter("reason IS NULL")
        return self._written("accepted", prepared.select("message_id", "message_order", "batch_id", "payload_hash"))

    @functools.cached_property
    def store(self) -> EventStore:
        """The messages streamed into a store until none is left."""
        store = EventStore(f"{self.root}/store")
        drain(store, self.message_stream, f"{self.root}/store-checkpoint")
        return store

    @functools.cached_property
    def indexed(self) -> EventStore:
        self.store.index(self.spark)
        return self.store

    @functools.cached_property
    def rolled_up(self) -> EventStore:
        self.twice_written.roll_up(self.spark)
        return self.twice_written

    @functools.cached_property
    def twice_written(self) -> EventStore:
        """Two epochs with the same messages, and a third that broke off before its commit."""
        store = EventStore(f"{self.root}/twice-written").create(self.spark)
        process_epoch(store, self.messages, 0)
        process_epoch(store, self.messages, 1)
        halfway = store.read(self.spark, "batches")
        store.write("batches", 2, halfway.withColumn("batch_id", F.concat("batch_id", F.lit("x"))))
        return store

    def ledger(self, known: DataFrame | None) -> DataFrame:
        """The ledger of a new store that holds some batches already."""
        store = EventStore(self.fresh("ledger")).create(self.spark)
        if known is not None:
            store.write("batches", 0, known.withColumn("created_at", F.current_timestamp()))
            store.commit(self.spark, 0, {})
        return store.read(self.spark, "batches")

    def table(self, name: str) -> DataFrame:
        return self.store.read(self.spark, name)

    @functools.cached_property
    def worker_log_path(self) -> str:
        path = f"{self.root}/worker-log"
        inputs.worker_lines(self.spark, self.sf_dir).write.partitionBy("run_id").text(path)
        return path

    @property
    def worker_log(self) -> DataFrame:
        return read_worker_log(self.spark, self.worker_log_path, "run_id string")

    @property
    def requests(self) -> DataFrame:
        return inputs.requests(self.spark, self.sf_dir)

    @functools.cached_property
    def runs(self) -> DataFrame:
        return self._written("runs", inputs.runs(self.spark, self.sf_dir))

    def run_reports(self) -> DataFrame:
        return run_report(self.runs, self.requests, worker_counts_of_runs(self.worker_log, self.runs))

    @functools.cached_property
    def reports_path(self) -> str:
        path = f"{self.root}/reports"
        write_run_reports(self.run_reports(), path)
        return path

    @property
    def manifest(self) -> DataFrame:
        return read_run_reports(self.spark, self.reports_path)


@functools.cache
def _workspace(application_id: str, sf_dir: str, spark: SparkSession) -> Workspace:
    return Workspace(spark, sf_dir)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    configure(spark)
    return _workspace(spark.sparkContext.applicationId, sf_dir, spark)
