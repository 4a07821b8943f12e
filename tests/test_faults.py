"""Cases that once lost data, were let in by mistake, or did not end."""

import json
import math

import pytest
from helpers import batch, event, messages

from batchloom import schemas as S
from batchloom.functions.canonical import canonical_batch_json
from batchloom.functions.contains import json_contains
from batchloom.operators import runs, spread
from batchloom.operators.decode import decode_batches
from batchloom.operators.ranks import value_at_rank
from batchloom.sources import reports
from batchloom.sources.messages import read_batch_messages
from batchloom.sources.store import EventStore
from batchloom.sources.worker_log import read_worker_log
from batchloom.streaming.ingest import prepare, process_epoch
from pyspark.sql import functions as F


def _runs(spark, *rows):
    made = spark.createDataFrame([(r, n) for r, n in rows], "run_id string, batches long")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return made.select(
        "run_id", start.alias("started_at"), (start + F.expr("INTERVAL 10 SECONDS")).alias("finished_at"), "batches",
        F.lit("u").alias("url"), F.lit(100).cast("long").alias("batch_size"), F.lit(8).alias("concurrency"),
    )


def _reports(spark, *rows):
    requests = spark.createDataFrame([], "run_id string, latency_ms double, status string, body_bytes long")
    workers = spark.createDataFrame([], "run_id string, worker_id string, processed long, validated long")
    return runs.run_report(_runs(spark, *rows), requests, workers)


def test_counts_have_64_bits(spark):
    report = _reports(spark, ("a", 30_000_000)).collect()[0]
    assert (report.batches, report.requested_events) == (30_000_000, 3_000_000_000)


def test_reports_with_one_finish_time_and_loose_files(spark, tmp_path):
    folder = str(tmp_path / "reports")
    reports.write_run_reports(_reports(spark, ("a", 1), ("b", 2)).coalesce(1), folder)
    one = reports.read_run_reports(spark, folder).collect()
    assert sorted(r.report.batches for r in one) == [1, 2]
    (tmp_path / "reports" / "loose.json").write_text(json.dumps({"batches": 3_000_000_000}, indent=2))
    (tmp_path / "reports" / "reports.json").write_text("[]")
    found = {(r.file, r.report.batches) for r in reports.read_run_reports(spark, folder).collect()}
    assert found == {(one[0].file, 1), (one[0].file, 2), ("loose.json", 3_000_000_000)}


def test_a_wrong_manifest_is_an_error(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part.json").write_text('{"file":"a","report":{"batches":"many"}}')
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        reports.read_run_manifest(spark, str(tmp_path / "m")).collect()


def test_lines_keep_their_text(spark, tmp_path):
    good = batch("b", event())
    lines = [
        json.dumps({"message_id": "m0", "message_order": 0, "batch_id": "b", "payload": good}), '{"message_id": "m1", "bat', "",
        json.dumps({"message_id": "m2", "message_order": 2, "batch_id": 5, "payload": good}),
        json.dumps({"message_id": "m3", "message_order": 3, "batch_id": "b", "payload": {"batch_id": "c"}}),
        json.dumps({"message_id": "m4", "message_order": 4, "batch_id": "d", "payload": good + " junk"}), "[1]",
    ]
    (tmp_path / "in.json").write_text("\n".join(lines))
    store = EventStore(str(tmp_path / "store")).create(spark)
    process_epoch(store, read_batch_messages(spark, str(tmp_path / "in.json")), 0)
    kept = {(r.message_id, r.reason, r.payload) for r in store.read(spark, "quarantine").collect()}
    assert kept == {
        ("", S.BAD_ENVELOPE, lines[1]), ("", S.BAD_ENVELOPE, "[1]"), ("m2", S.BAD_ENVELOPE_ID, good),
        ("m3", S.BAD_ENVELOPE_PAYLOAD, '{"batch_id":"c"}'), ("m4", S.INVALID_JSON, good + " junk"),
    }
    assert store.read(spark, "batches").count() == 1


@pytest.mark.parametrize("rest", [" junk", "}", "] x", ",2", ',"a"]'])
def test_only_the_queue_refuses_trailing_text(spark, rest):
    body = spark.createDataFrame([(batch("b", event()) + rest,)], "payload string")
    assert decode_batches(body).first().decode_error is None
    assert decode_batches(body, strict=True).first().decode_error == S.INVALID_JSON


def test_a_message_without_order_comes_last(spark, tmp_path):
    first, other = batch("b", event()), batch("b", event(orgid="q"))
    rows = [("m0", None, "b", other), ("m1", 1, "b", first)]
    store = EventStore(str(tmp_path / "store")).create(spark)
    process_epoch(store, spark.createDataFrame(rows, S.MESSAGE), 0)
    assert {r.message_id: r.status for r in store.read(spark, "outcomes").collect()} == {"m0": "conflict", "m1": "new"}


def _with_number(spelled):
    return batch("b", event(properties={"a": "@"})).replace('"@"', spelled)


def test_numbers_hash_by_value(spark):
    same = ["100", "1e2", "1.0E2", "100.0", "100.00"]
    hashes = prepare(messages(spark, [_with_number(n) for n in [*same, "101", '"100"', "0.1"]])).orderBy("message_order")
    found = [r.payload_hash for r in hashes.collect()]
    assert len(set(found[:5])) == 1 and len(set(found)) == 4


def test_strings_are_not_numbers(spark):
    text = 'x 1.50, "2e3" -7.0'
    prepared = prepare(messages(spark, [batch("b", event(properties={"a": text, "n": 2.50}))]))
    canonical = prepared.select(canonical_batch_json("batch_id", "valid_list").alias("c")).first().c
    assert json.loads(canonical)["events"][0]["properties"] == {"a": text, "n": 2.5}


def test_numbers_beyond_a_float_fail_the_batch(spark):
    reasons = [r.reason for r in prepare(messages(spark, [_with_number(n) for n in ("1e400", '"1e400"', "-1E+999", "1e300")])).orderBy("message_order").collect()]
    assert reasons == [S.INVALID_JSON, None, S.INVALID_JSON, None]


def test_containment_of_big_numbers(spark):
    doc = spark.sql("""SELECT parse_json('{"k":12345678901234567890,"d":0.10,"e":1e20}') AS doc""")
    cases = [({"k": 12345678901234567890}, True), ({"k": 12345678901234567891}, False), ({"d": 0.1}, True), ({"d": 0.11}, False), ({"e": 10**20}, True)]
    assert [doc.select(json_contains(F.col("doc"), p)).first()[0] for p, _ in cases] == [x for _, x in cases]


def test_a_missing_log_gives_no_workers(spark, tmp_path):
    lines = read_worker_log(spark, str(tmp_path / "none"), "run_id string")
    made = _runs(spark, ("a", 1))
    counts = runs.worker_counts_of_runs(lines, made)
    requests = spark.createDataFrame([("a", 5.0, "202", 1)], "run_id string, latency_ms double, status string, body_bytes long")
    assert runs.run_report(made, requests, counts).first().workers is None


def test_ranks_end_with_odd_values(spark):
    values = [1.0, 2.0, math.nan, math.inf, -math.inf, None, 3.0]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", math.nan)], "k string, v double")
    found = value_at_rank(rows, ["k"], "v", [0.5, 0.99]).collect()
    assert [(r.k, r.n, r.low, r.high, r.p50, r.p99) for r in found] == [("a", 3, 1.0, 3.0, 2.0, 2.0)]


def test_all_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS_PER_SALT", 3)
    monkeypatch.setattr(spread, "fits_broadcast", lambda *_: False)
    rows = spark.range(8_000).select((F.col("id") % 1_500).alias("k"), "id")
    lookup = spark.range(1_500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = spread.lookup_join(rows, lookup, ["k"], F.col("id"))
    assert joined.filter("v = 2 * k").count() == 8_000
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_broadcasts_are_bounded_by_bytes(spark):
    rows = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("k"))
    assert spread.fits_broadcast(rows) and not spread.fits_broadcast(rows, max_bytes=5_000)
