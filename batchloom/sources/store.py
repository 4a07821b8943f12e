"""The event store: Parquet folders per epoch, and one marker per stream that says how far it is whole.

One writer at a time. Every epoch writes ``<table>/stream=S/epoch=E`` of each table by overwrite, and last of all the
marker. The epochs of a stream come one after another, so all up to the marker are complete: readers keep only those, by
a filter on the folders and without a join, and see the store as it was when ``read`` was called. A half-written epoch
is never seen, and running it again replaces what an earlier try left behind.

The marker is an empty file ``commits/<stream>/<first epoch>-<last epoch>``. The next one is made before the old one is
removed, so a listing always shows the last epoch; nothing is ever decided by a file that was removed.

Layout: events are in folders by day, sorted along a curve over project, organization and user. The ledger is bucketed
by batch id, and each bucket is a folder too: a join by batch id reads it without a shuffle, and only the buckets that
the other side has ids in. Epoch numbers belong to one stream checkpoint: a stream begun afresh has a new name, so its
epoch 0 is not taken for one already done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom import schemas as S
from batchloom.functions.contains import json_contains
from batchloom.operators.layout import bucket, cell, event_day
from batchloom.operators.lookups import daily_counts, merged_counts
from batchloom.operators.postings import PART, in_parts, matching_parts, postings

TABLES = {
    "events": S.EVENTS,
    "batches": S.BATCHES,
    "outcomes": S.OUTCOMES,
    "quarantine": S.QUARANTINE,
}
BLOOM_FILTERS = {"events": ("batch_id", "user_id", "funnel_id", "org_id")}
_KEY_FIELDS = [T.StructField("stream", T.StringType()), T.StructField("epoch", T.LongType())]
#: Columns that say where an event lies; ``event_day`` is a folder.
_PLACED = {
    "events": [
        T.StructField("cell", T.IntegerType()), T.StructField("part", T.LongType()),
        T.StructField("event_day", T.IntegerType()),
    ]
}
#: Rows of a part of a file of events, as a power of two; row groups hold whole parts but for their ends.
PART_BITS = 13
#: Slices of a cell that are sorted and written apart.
SLICES = 16
#: Parts that a lookup by postings names one by one; beyond that they are joined.
MOST_PARTS = 1_000
#: Buckets of a new store's ledger; an existing store keeps its own number.
BUCKETS = 16

#: Last epoch of every stream, with its first one.
Snapshot = dict[str, tuple[int, int]]


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


@dataclass(frozen=True)
class EventStore:
    root: str
    stream: str = "batch"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def epoch_path(self, table: str, epoch: int) -> str:
        return f"{self.path(table)}/stream={self.stream}/epoch={epoch}"

    def work_path(self, step: str) -> str:
        """Where a stream keeps an intermediate table; every epoch overwrites it."""
        return f"{self.root}/work/{self.stream}/{step}"

    def create(self, spark: SparkSession, buckets: int = BUCKETS) -> EventStore:
        """Make the table folders, so that reading an empty store is no error.

        ``buckets`` of the ledger should be so many that one holds what a task can sort: batch ids are kept for ever.
        """
        folders = [self.path(table) for table in TABLES]
        if not _children(spark, self.path("batches")):
            folders.append(f"{self.path('batches')}/buckets={buckets}")
        for folder in folders:
            fs, path = _file_system(spark, folder)
            fs.mkdirs(path)
        return self

    # Markers

    def _marks(self, spark: SparkSession, kind: str) -> Snapshot:
        found = {}
        for stream in _children(spark, self.path(kind)):
            marks = [tuple(map(int, m.split("-"))) for m in _children(spark, f"{self.path(kind)}/{stream}")]
            if marks:
                found[stream] = max(marks, key=lambda m: m[1])
        return found

    def _mark(self, spark: SparkSession, kind: str, stream: str, epochs: tuple[int, int]) -> None:
        folder = f"{self.path(kind)}/{stream}"
        fs, mark = _file_system(spark, f"{folder}/{epochs[0]}-{epochs[1]}")
        fs.create(mark, True).close()
        for name in _children(spark, folder):
            if int(name.split("-")[1]) < epochs[1]:
                fs.delete(_file_system(spark, f"{folder}/{name}")[1], False)

    def snapshot(self, spark: SparkSession) -> Snapshot:
        """What is committed now."""
        return self._marks(spark, "commits")

    def is_committed(self, snapshot: Snapshot, epoch: int) -> bool:
        first, last = snapshot.get(self.stream, (epoch, epoch - 1))
        if not first <= epoch <= last + 1:
            raise ValueError(f"epoch {epoch} of stream {self.stream} does not follow its epochs {first} to {last}")
        return epoch <= last

    def commit(self, spark: SparkSession, epoch: int, snapshot: Snapshot) -> None:
        """Mark an epoch as complete, all others of the stream before it being so in ``snapshot``."""
        first = snapshot.get(self.stream, (epoch, epoch))[0]
        self._mark(spark, "commits", self.stream, (first, epoch))

    # Reading

    def buckets(self, spark: SparkSession) -> int:
        """Buckets of the ledger."""
        return int(_children(spark, self.path("batches"))[0].removeprefix("buckets="))

    def _ledger(self, spark: SparkSession) -> str:
        """Name of the ledger in the session's catalog, which is how Spark knows of the buckets."""
        buckets = self.buckets(spark)
        place = f"{self.path('batches')}/buckets={buckets}"
        name = f"batchloom_ledger_{hashlib.sha256(place.encode()).hexdigest()[:24]}"
        if not spark.catalog.tableExists(name):
            kept = spark.conf.get("spark.sql.hive.manageFilesourcePartitions")
            spark.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")  # the folders say what is there
            try:
                spark.sql(
                    f"CREATE TABLE {name} ({_columns(S.BATCHES.fields + _KEY_FIELDS)}, part INT) USING parquet "
                    f"OPTIONS (`parquet.bloom.filter.enabled#batch_id` 'true') PARTITIONED BY (stream, epoch, part) "
                    f"CLUSTERED BY (batch_id) SORTED BY (batch_id) INTO {buckets} BUCKETS LOCATION '{place}'"
                )
            finally:
                spark.conf.set("spark.sql.hive.manageFilesourcePartitions", kept)
        spark.catalog.refreshTable(name)
        return name

    def _raw(self, spark: SparkSession, table: str) -> DataFrame:
        if table == "batches":
            return spark.table(self._ledger(spark))
        fields = TABLES[table].fields + _PLACED.get(table, []) + _KEY_FIELDS
        return spark.read.schema(T.StructType(fields)).parquet(self.path(table))

    def read(self, spark: SparkSession, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """Committed rows of a table, of all streams.

        The ledger also has ``part``, its bucket, and events have ``cell``, ``part`` and ``event_day``, for the filters
        in ``layout`` and ``postings``.
        """
        return self._committed(spark, table, snapshot).drop("stream", "epoch")

    def _committed(self, spark: SparkSession, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        snapshot = self.snapshot(spark) if snapshot is None else snapshot
        committed = F.lit(False)
        for stream, (first, last) in snapshot.items():
            committed = committed | ((F.col("stream") == stream) & F.col("epoch").between(first, last))
        return self._raw(spark, table).filter(committed)

    def read_batch(self, spark: SparkSession, batch_id: str) -> DataFrame:
        """Events of one batch: the ledger, of which one bucket is read, names the folder that holds them."""
        snapshot = self.snapshot(spark)
        own = (F.col("batch_id") == batch_id) & (F.col("part") == bucket(F.lit(batch_id), self.buckets(spark)))
        owner = self._committed(spark, "batches", snapshot).filter(own).select("stream", "epoch").head()  # one at most
        events = self._committed(spark, "events", snapshot)
        where = F.lit(False)
        if owner:
            where = (F.col("stream") == owner.stream) & (F.col("epoch") == owner.epoch)
        return events.filter(where & (F.col("batch_id") == batch_id)).drop("stream", "epoch")

    def written(self, spark: SparkSession, table: str, epoch: int) -> DataFrame:
        """What an epoch wrote to a table, committed or not."""
        return spark.read.schema(TABLES[table]).parquet(self.epoch_path(table, epoch))

    # Writing

    def write(self, table: str, epoch: int, rows: DataFrame) -> None:
        rows = rows.select(*TABLES[table].fieldNames())
        if table == "batches":
            self._write_ledger(epoch, rows)
        elif table == "events":
            self._write_events(epoch, rows)
        else:
            rows.write.mode("overwrite").parquet(self.epoch_path(table, epoch))

    def _write_events(self, epoch: int, rows: DataFrame) -> None:
        """Events in folders by day, along the curve inside each file; one shuffle, which splits what is too large.

        Bloom filters skip row groups without a batch, user, funnel or organization that is asked for.
        """
        placed = rows.withColumns({"event_day": event_day(F.col("timestamp_ms")), "cell": cell()})
        # A cell may hold most events, so each is cut into slices; a batch stays in one.
        sliced = placed.withColumn("slice", F.pmod(F.xxhash64("batch_id"), F.lit(SLICES)))
        dealt = sliced.hint("rebalance", F.col("event_day"), F.col("cell"), F.col("slice")).drop("slice")
        order = ["event_day", "cell", "project_id", "name", "timestamp_ms"]
        part = F.shiftright(F.monotonically_increasing_id(), PART_BITS)
        ordered = dealt.sortWithinPartitions(*order).withColumn("part", part)
        writer = ordered.write.mode("overwrite").partitionBy("event_day")
        for column in BLOOM_FILTERS["events"]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(self.epoch_path("events", epoch))

    def _write_ledger(self, epoch: int, rows: DataFrame) -> None:
        spark = rows.sparkSession
        name, buckets = self._ledger(spark), self.buckets(spark)
        fs, left = _file_system(spark, f"{self.path('batches')}/buckets={buckets}/stream={self.stream}/epoch={epoch}")
        fs.delete(left, True)
        keys = {"stream": F.lit(self.stream), "epoch": F.lit(epoch).cast("bigint")}
        rows = rows.withColumns({**keys, "part": bucket(F.col("batch_id"), buckets)})
        rows.hint("rebalance", F.col("part")).write.insertInto(name)

    # Tables made from the events afterwards: postings of the properties, daily counts

    def _derive(self, spark: SparkSession, kind: str, build: Callable[[DataFrame], DataFrame]) -> None:
        """Write what ``build`` makes of the committed epochs that ``kind`` does not cover yet, stream by stream.

        A try that breaks off is replaced by the next one, since the marker comes last.
        """
        done, snapshot = self._marks(spark, f"{kind}-done"), self.snapshot(spark)
        for stream, (first, last) in snapshot.items():
            start = max(first, done.get(stream, (first, first - 1))[1] + 1)
            if start > last:
                continue
            own = (F.col("stream") == stream) & F.col("epoch").between(start, last)
            made = build(self._committed(spark, "events", snapshot).filter(own))
            made.write.mode("overwrite").parquet(f"{self.path(kind)}/stream={stream}/start={start}")
            self._mark(spark, f"{kind}-done", stream, (first, last))

    def _derived(self, spark: SparkSession, kind: str, fields: list[T.StructField], done: Snapshot) -> DataFrame:
        """What ``_derive`` wrote; folders beyond the marker come from a try that broke off."""
        schema = T.StructType([*fields, T.StructField("stream", T.StringType()), T.StructField("start", T.LongType())])
        whole = F.lit(False)
        for stream, (_, last) in done.items():
            whole = whole | ((F.col("stream") == stream) & (F.col("start") <= last))
        return spark.read.schema(schema).parquet(self.path(kind)).filter(whole)

    def _covered(self, snapshot: Snapshot, done: Snapshot) -> tuple[Column, bool]:
        """Predicate over rows of epochs that a derived table covers, and whether all committed ones are."""
        covered, whole = F.lit(False), True
        for stream, (first, last) in snapshot.items():
            end = done.get(stream, (first, first - 1))[1]
            covered = covered | ((F.col("stream") == stream) & F.col("epoch").between(first, end))
            whole = whole and end >= last
        return covered, whole

    def roll_up(self, spark: SparkSession) -> None:
        """Write the daily counts of all committed epochs that have none yet; reads count the others as they are."""
        self._derive(spark, "daily", daily_counts)

    def read_daily(self, spark: SparkSession) -> DataFrame:
        """``daily_counts`` of all committed events: of rolled-up epochs a few rows are read instead of their events."""
        snapshot, done = self.snapshot(spark), self._marks(spark, "daily-done")
        covered, whole = self._covered(snapshot, done)
        events = self._committed(spark, "events", snapshot)
        if not done:
            return daily_counts(events)
        schema = daily_counts(events).schema
        counted = self._derived(spark, "daily", schema.fields, done).select(*schema.fieldNames())
        return merged_counts(counted if whole else counted.unionByName(daily_counts(events.filter(~covered))))

    def index(self, spark: SparkSession) -> None:
        """Write the postings of all committed epochs that have none yet; lookups read the others without."""

        def build(events: DataFrame) -> DataFrame:
            # Terms are hashes, so their first bits deal them evenly; sorted, a lookup reads the row groups of its terms.
            found = postings(events).drop("stream").withColumn("slice", F.shiftright("term", 58))
            return found.hint("rebalance", F.col("slice")).drop("slice").sortWithinPartitions("term")

        self._derive(spark, "postings", build)

    def find(self, spark: SparkSession, pattern) -> DataFrame:
        """Events whose properties contain ``pattern``; of the indexed epochs only the parts that may hold one are read."""
        snapshot, indexed = self.snapshot(spark), self._marks(spark, "postings-done")
        events = self._committed(spark, "events", snapshot)
        parts = None
        if indexed:
            fields = [T.StructField("epoch", T.LongType()), T.StructField("event_day", T.IntegerType())]
            fields += [T.StructField(n, T.LongType()) for n in ("part", "term")]
            parts = matching_parts(self._derived(spark, "postings", fields, indexed), pattern)
        if parts is not None:
            covered, whole = self._covered(snapshot, indexed)
            listed = parts.limit(MOST_PARTS + 1).collect()
            if len(listed) <= MOST_PARTS:
                found = events.filter(in_parts(listed))
            else:
                found = events.join(parts, PART, "left_semi")
            events = found if whole else found.unionByName(events.filter(~covered))
        return events.filter(json_contains(F.col("properties"), pattern)).drop("stream", "epoch")

    def rewrite(self, spark: SparkSession, root: str) -> EventStore:
        """All committed rows as one epoch of a new store at ``root``: fewer files, the same rows and markers.

        A plain read and write that leaves this store as it is. Streams go on in the new store once it is returned;
        this one must not be written to meanwhile.
        """
        snapshot = self.snapshot(spark)
        made = EventStore(root, "rewritten").create(spark, self.buckets(spark))
        for table in TABLES:
            made.write(table, 0, self.read(spark, table, snapshot))
        made.commit(spark, 0, {})
        for stream, (first, last) in snapshot.items():
            replace(made, stream=stream).commit(spark, last, {stream: (first, last)})
        return replace(made, stream=self.stream)


def _columns(fields: list[T.StructField]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
