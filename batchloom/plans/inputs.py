"""Inputs derived from the ``events`` table by fixed rules: messages, bodies, requests, worker log, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.display import epoch_millis

BATCH = 25


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _every(n: int, rest: int, number: Column | None = None) -> Column:
    number = F.col("event_id") if number is None else number
    return number % n == rest


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def wire_event() -> Column:
    """One wire event per source row; NULL fields are absent keys."""
    eid, user, b = F.col("event_id"), F.col("user_id"), F.col("b")
    return F.struct(
        F.when(_every(3, 0), _text("e", eid)).alias("id"),
        F.when(_every(17, 3), "").otherwise(F.col("event_type")).alias("event"),
        F.when(_every(19, 5), 0).otherwise(epoch_millis(F.col("ts"))).cast("bigint").alias("timestamp"),
        F.when(_every(23, 7), "").otherwise(_text("project_", user % 5)).alias("projectid"),
        F.when(_every(29, 11) | _every(40, 23, b), "").otherwise(_text("org_", user % 3)).alias("orgid"),
        F.when(F.col("event_type").isin("signup", "purchase"), "signup_funnel").alias("funnelid"),
        F.when(~_every(4, 0), user.cast("string")).alias("user_id"),
        F.when(_every(4, 0), _text("anon_", user)).alias("anonymous_id"),
        F.when(_every(31, 0), "").alias("session_id"),
        F.when(~_every(13, 0), F.parse_json("props")).alias("properties"),
        F.when(
            _every(2, 0), F.parse_json(F.concat(F.lit('{"page":"/p'), (eid % 7).cast("string"), F.lit('"}')))
        ).alias("context"),
    )


def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, b, i, ts, event``: place ``i`` of batch ``b``."""
    return (
        source_events(spark, sf_dir)
        .withColumn("b", F.expr(f"event_id div {BATCH}"))
        .withColumn("i", (F.col("event_id") % BATCH).cast("int"))
        .select("event_id", "b", "i", "ts", wire_event().alias("event"))
    )


def _renamed(event: Column) -> Column:
    name = F.when(event["event"] == "", "").otherwise(F.concat(event["event"], F.lit("_v2")))
    return event.withField("event", name)


def _nameless(event: Column) -> Column:
    return event.withField("event", F.lit(""))


def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch once, some again: identical, with other names, or with one more invalid event in front."""
    b = F.col("b")
    batches = (
        wire_events(spark, sf_dir)
        .groupBy("b")
        .agg(F.collect_list(F.struct("i", "event")).alias("rows"))
        .withColumn("rows", F.array_sort("rows", lambda x, y: x["i"] - y["i"]))
        .select("b", F.transform("rows", lambda r: r["event"]).alias("all_events"))
        .withColumn("base", F.when(_every(40, 37, b), F.slice("all_events", 1, 0)).otherwise(F.col("all_events")))
        .withColumn("label", F.when(_every(40, 31, b), "").otherwise(_text("b", b)))
    )

    def delivery(k: int, events: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), events.alias("events"))

    deliveries = F.array(
        delivery(0, F.col("base")),
        F.when(_every(10, 4, b), delivery(1, F.col("base"))),
        F.when(_every(10, 6, b), delivery(2, F.transform("base", _renamed))),
        F.when(_every(10, 8, b), delivery(3, F.concat(F.transform(F.slice("base", 1, 1), _nameless), F.col("base")))),
    )
    order = F.col("b") * 10 + F.col("d.k")
    return (
        batches.select("b", "label", F.explode(F.array_compact(deliveries)).alias("d"))
        .select(
            _text("m", order).alias("message_id"),
            order.alias("message_order"),
            F.col("label").alias("batch_id"),
            F.to_json(F.struct(F.col("label").alias("batch_id"), F.col("d.events").alias("events"))).alias("payload"),
        )
    )


def batch_bodies(messages: DataFrame) -> DataFrame:
    """Message payloads with one defect or oddity per group of batches."""
    group = F.expr("message_order div 10") % 10
    text = F.col("payload")

    def swap(old: str, new: str) -> Column:
        return F.replace(text, F.lit(old), F.lit(new))

    return messages.select(
        "message_id",
        F.when(group == 0, "[]")
        .when(group == 1, F.left(text, F.length(text) - 1))
        .when(group == 2, "null")
        .when(group == 3, swap('"orgid":"', '"orgid":1,"x":"'))
        .when(group == 5, F.replace(swap('"event":', '"EVENT":'), F.lit('"batch_id":'), F.lit('"Batch_ID":')))
        .when(group == 7, F.concat(text, F.lit(" trailing")))
        .when(group == 9, swap('"events":', '"extra":{"deep":[1,null]},"events":'))
        .otherwise(text)
        .alias("body"),
    )


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-event request bodies with one defect or oddity per group of events."""
    text = F.to_json("event")
    group = F.col("event_id") % 11

    def swap(old: str, new: str) -> Column:
        return F.replace(text, F.lit(old), F.lit(new))

    return wire_events(spark, sf_dir).select(
        "event_id",
        F.when(group == 1, swap('"timestamp":', '"timestamp":1.5,"x":'))
        .when(group == 2, F.left(text, F.length(text) - 1))
        .when(group == 3, "null")
        .when(group == 4, swap('"event":', '"EVENT":'))
        .when(group == 5, swap('"event":"', '"event":5,"x":"'))
        .when(group == 6, F.concat(F.left(text, F.length(text) - 1), F.lit(',"properties":[]}')))
        .when(group == 7, F.concat(F.left(text, F.length(text) - 1), F.lit(',"more":[{"a":null}]} junk')))
        .when(group == 8, "")
        .when(group == 9, F.concat(F.left(text, F.length(text) - 1), F.lit(',"more":[1e400]}')))
        .otherwise(text)
        .alias("body"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempted request per source event."""
    return source_events(spark, sf_dir).select(
        _text("run-", F.col("event_id") % 4).alias("run_id"),
        F.col("value").alias("latency_ms"),
        F.when(~_every(50, 0), F.when(F.col("event_type") == "error", "500").otherwise("202")).alias("status"),
        (F.length("props") * 100).cast("bigint").alias("body_bytes"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per ``event_id % 4``, every source event one requested batch of 25 events."""
    return (
        source_events(spark, sf_dir)
        .groupBy(_text("run-", F.col("event_id") % 4).alias("run_id"))
        .agg(
            F.min("ts").cast("timestamp").alias("started_at"),
            F.max("ts").cast("timestamp").alias("finished_at"),
            F.count("*").alias("batches"),
        )
        .withColumns({
            "url": F.lit("http://localhost:8080/v1/batch"),
            "batch_size": F.lit(BATCH).cast("bigint"),
            "concurrency": F.lit(8),
        })
    )


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery or acknowledgement per source event, a message for every user and day."""
    ms = epoch_millis(F.col("ts"))
    return source_events(spark, sf_dir).select(
        F.concat_ws("-", F.lit("m"), F.col("user_id").cast("string"), F.floor(ms / 86_400_000).cast("string")).alias("message_id"),
        _text("worker-", F.col("event_id") % 12).alias("consumer"),
        F.when(F.col("event_type").isin("purchase", "error"), "acknowledged").otherwise("delivered").alias("kind"),
        # Times by the minute, so that some are equal and some leases end just when they could be claimed.
        (F.floor(ms / 60_000) * 60_000).alias("at_ms"),
    )


def worker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per source event, as ``run_id, value``: errors name no worker, purchases have no time."""
    kind = F.col("event_type")
    line_time = F.concat(F.lit('time="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"'))
    message = (
        F.when(kind == "click", "Worker processed batch")
        .when(kind == "view", "Worker validated batch")
        .when(kind == "signup", "Worker started")
        .otherwise("Worker stopped")
    )
    return source_events(spark, sf_dir).select(
        _text("run-", F.col("event_id") % 4).alias("run_id"),
        F.concat_ws(
            " ",
            F.when(kind != "purchase", line_time),
            F.lit("level=info"),
            F.concat(F.lit('msg="'), message, F.lit('"')),
            F.when(kind != "error", _text("worker_id=worker-", F.col("user_id") % 12)),
        ).alias("value"),
    )
