"""What the plans must and must not hold."""

import types

import pytest

import __spark_entry__ as entry_module
from batchloom import session
from batchloom.operators import ledger as L
from batchloom.operators import lookups
from batchloom.operators.layout import DAY_MS
from batchloom.operators.lookups import events_by_properties
from batchloom.plans.workspace import workspace
from batchloom.sources.store import EventStore
from batchloom.streaming.ingest import process_epoch
from helpers import batch, event, messages, scan_of

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.QUERIES  # those over training text use Python, and are tested in their own folder


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"replay_recovery", "append_batches", "write_run_report"}))
def test_no_pairing_joins_and_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert banned not in plan
    # A window or a sort of everything in one task shows as a single-partition exchange.
    assert "Exchange SinglePartition" not in plan


@pytest.mark.parametrize(
    "name", ["filter_valid_events", "rejected_events", "validate_batch", "payload_hash", "canonical_batch_json"]
)
def test_payloads_are_decoded_once(spark, name):
    assert _plan(QUERIES[name](spark, SF)).count("from_json(") == 2  # the envelope and its payload


def test_filters_reach_thescan_of(spark, long_metadata):
    plan = _plan(QUERIES["events_by_project_time"](spark, SF))
    for pushed in ("EqualTo(project_id,project_1)", "EqualTo(name,click)", "GreaterThanOrEqual(timestamp_ms"):
        assert pushed in plan
    plan = _plan(QUERIES["batch_by_id"](spark, SF))
    assert "EqualTo(batch_id,b7)" in plan and "Join" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<batch_id:string,payload_hash:string>" in plan


@pytest.fixture(scope="module")
def many_days(spark, tmp_path_factory):
    """A store of 64 days, 40 projects, organizations and users each, in two epochs."""
    store = EventStore(str(tmp_path_factory.mktemp("plans") / "store")).create(spark)
    for epoch in range(2):
        sent = [
            batch(f"b{epoch}-{d}", *[event(timestamp=1 + d * DAY_MS, projectid=f"p{i}", orgid=f"o{i}", user_id=f"u{i}") for i in range(40)])
            for d in range(64)
        ]
        process_epoch(store, messages(spark, sent), epoch)
    return store


def test_a_time_range_opens_the_files_of_its_days(spark, many_days):
    events = many_days.read(spark, "events")
    assert scan_of(events.select("batch_id"), "events")[2] == 128
    found = lookups.events_by_org_time(events, "o3", 10 * DAY_MS, 12 * DAY_MS - 1)
    rows, scan, files = scan_of(found, "events")
    assert len(rows) == files == 4 and "event_day" in scan.split("PartitionFilters")[1]
    assert scan_of(lookups.events_by_user_time(events, "u3", 0, DAY_MS), "events")[2] == 4
    assert scan_of(lookups.funnel_timeline(events, "", 0, 6), "events")[2] == 2


def test_lookups_name_runs_of_cells(spark, many_days, long_metadata):
    events = many_days.read(spark, "events")
    for frame, runs in (
        (lookups.events_by_project_name(events, "p1", "click"), 4),
        (lookups.events_by_org_time(events, "o1", 0, DAY_MS), 8),
        (lookups.events_by_user_time(events, "u1"), 16),
    ):
        pushed = _plan(frame).split("PushedFilters")[1]
        assert pushed.count("GreaterThanOrEqual(cell,") == runs
        cells = {r.cell for r in frame.select("cell").collect()}
        assert len(cells) == 1  # one id of each column: one cell


def test_a_batch_opens_one_epoch(spark, many_days):
    rows, _, files = scan_of(many_days.read_batch(spark, "b1-7"), "events")
    assert len(rows) == 40 and files == 64
    ledger = many_days.read(spark, "batches")
    rows, _, files = scan_of(lookups.batch_by_id(ledger, "b1-7", many_days.buckets(spark)), "ledger")
    assert len(rows) == 1 and files == 2  # one bucket of two epochs


@pytest.mark.parametrize("partitions", ["4", "64"])
@pytest.mark.parametrize("ids", [1, 40, 20_000])
def test_the_ledger_does_not_move(spark, many_days, long_metadata, ids, partitions):
    """However many ids an epoch has, it reads the buckets of its ids only, and none of the ledger is shuffled."""
    buckets = many_days.buckets(spark)
    stored = {r.batch_id: r.payload_hash for r in many_days.read(spark, "batches").collect()}
    rows = [(str(i), i, f"b1-{i}", stored.get(f"b1-{i}", "h")) for i in range(ids)]
    contents = L.batch_contents(spark.createDataFrame(rows, "message_id string, message_order long, batch_id string, payload_hash string"))
    wanted = contents.agg(L.content_parts(buckets)).first()[0]
    known = L.relevant_ledger(many_days.read(spark, "batches"), wanted)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found, scan, files = scan_of(L.judge_contents(contents, known, buckets), "ledger")
        plan = _plan(L.judge_contents(contents, known, buckets))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sorted(r.verdict for r in found) == sorted(["duplicate"] * min(ids, 64) + ["new"] * (ids - min(ids, 64)))
    assert "Bucketed: true" in scan and files <= 2 * len(wanted)
    # Above the ledger's scan nothing but its filter and sort comes before the join.
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "ledger" in line)
    depth, above = lines[at].index("FileScan"), []
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth:
            depth = here
            above.append(line.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0])
            if above[-1] == "SortMergeJoin":
                break
    assert above[-1] == "SortMergeJoin" and not any("Exchange" in step for step in above)


def test_containment_reads_one_path(spark, long_metadata):
    """The scan extracts the path asked for instead of handing on whole documents."""
    frame = workspace(spark, SF).table("events")
    plan = _plan(events_by_properties(frame, {"k": 87}).select("batch_id"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "properties" in line)
    assert "ReadSchema: struct<batch_id:string,properties:struct<" in scan


def test_one_shuffle_serves_both_uses_of_the_contents(spark):
    contents = L.batch_contents(workspace(spark, SF).accepted)
    verdicts = L.judge_contents(contents, spark.createDataFrame([], "batch_id string, payload_hash string"), 4)
    verdicts.collect()
    assert "ReusedExchange" in _plan(verdicts)


@pytest.mark.parametrize("name", ["new_batches", "batch_conflicts", "batch_redeliveries", "stream_first_writer"])
def test_verdicts_need_no_ingested_store(spark, name):
    made = workspace(spark, "/root/testdata/sf0.001")
    made.__dict__.pop("store", None)
    entry_module.queries()[name](spark, made.sf_dir)
    assert "store" not in made.__dict__


def test_shared_folder():
    named = {"spark.checkpoint.dir": "/shared/x/"}
    assert session.shared_dir(types.SimpleNamespace(conf=named)) == "/shared/x"
    with pytest.raises(RuntimeError):
        session.shared_dir(types.SimpleNamespace(conf={}, sparkContext=types.SimpleNamespace(master="yarn")))
    local = types.SimpleNamespace(master="local[8]", applicationId="test-application")
    first = session.shared_dir(types.SimpleNamespace(conf={}, sparkContext=local))
    assert first == session.shared_dir(types.SimpleNamespace(conf={}, sparkContext=local))
