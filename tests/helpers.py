"""Builders for small messages."""

import json

from batchloom import schemas as S


def event(**changes):
    made = {"event": "click", "timestamp": 1, "projectid": "p", "orgid": "o"}
    made.update(changes)
    return {k: v for k, v in made.items() if v is not ...}


def batch(batch_id, *events):
    return json.dumps({"batch_id": batch_id, "events": list(events)})


def messages(spark, payloads):
    rows = [(f"m{i}", i, "envelope", p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, S.MESSAGE)


def scan_of(frame, table):
    """Rows of a frame, the scan of the one stored table in it, and the number of files that it read."""
    rows = frame.collect()
    [scan] = [leaf for leaf in _leaves(frame._jdf.queryExecution().executedPlan()) if table in leaf.toString()]
    return rows, scan.toString(), scan.metrics().apply("numFiles").value()


def _leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _leaves(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _leaves(plan.plan())
    children = plan.children()
    found = [] if children.size() else [plan]
    for i in range(children.size()):
        found += _leaves(children.apply(i))
    return found
