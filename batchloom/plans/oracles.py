"""The registered queries as plain SQL over the given tables."""

from __future__ import annotations

from batchloom import schemas as S
from batchloom.plans import registry as R

# The derived messages, event by event.
_WIRE = """
wire AS (
  SELECT event_id, event_id // 25 AS b, CAST(event_id % 25 AS INTEGER) AS i,
    CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS id,
    CASE WHEN event_id % 17 = 3 THEN '' ELSE event_type END AS name,
    CASE WHEN event_id % 19 = 5 THEN 0 ELSE epoch_us(ts) // 1000 END AS timestamp_ms,
    CASE WHEN event_id % 23 = 7 THEN '' ELSE 'project_' || (user_id % 5) END AS project_id,
    CASE WHEN event_id % 29 = 11 OR (event_id // 25) % 40 = 23 THEN '' ELSE 'org_' || (user_id % 3) END AS org_id,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'signup_funnel' END AS funnel_id,
    CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
    CASE WHEN event_id % 4 = 0 THEN 'anon_' || user_id END AS anonymous_id,
    CASE WHEN event_id % 31 = 0 THEN '' END AS session_id,
    CASE WHEN event_id % 13 <> 0 THEN replace(props, ' ', '') END AS properties,
    CASE WHEN event_id % 2 = 0 THEN '{"page":"/p' || (event_id % 7) || '"}' END AS context
  FROM events
)"""

_MESSAGES = f"""{_WIRE},
messages AS (
  SELECT b, k, b * 10 + k AS message_order, 'm' || (b * 10 + k) AS message_id,
    CASE WHEN b % 40 = 31 THEN '' ELSE 'b' || b END AS batch_id
  FROM (SELECT DISTINCT b FROM wire) AS all_batches, (VALUES (0), (1), (2), (3)) AS deliveries(k)
  WHERE k = 0 OR (k = 1 AND b % 10 = 4) OR (k = 2 AND b % 10 = 6) OR (k = 3 AND b % 10 = 8)
),
message_events AS (
  SELECT m.message_order, m.message_id, m.batch_id, w.i + (CASE WHEN k = 3 THEN 1 ELSE 0 END) AS pos,
    id, CASE WHEN k = 2 AND name <> '' THEN name || '_v2' ELSE name END AS name, timestamp_ms, project_id,
    org_id, funnel_id, user_id, anonymous_id, session_id, properties, context
  FROM messages m JOIN wire w ON m.b = w.b WHERE m.b % 40 <> 37
  UNION ALL
  SELECT m.message_order, m.message_id, m.batch_id, 0, id, '', timestamp_ms, project_id, org_id, funnel_id,
    user_id, anonymous_id, session_id, properties, context
  FROM messages m JOIN wire w ON m.b = w.b WHERE m.k = 3 AND w.i = 0
)"""


def _optional(key: str, column: str, quote: str = '"') -> str:
    return f"""CASE WHEN {column} IS NULL THEN '' ELSE ',"{key}":{quote}' || {column} || '{quote}' END"""


_PAYLOADS = f"""{_MESSAGES},
payloads AS (
  SELECT m.message_order, m.message_id, m.batch_id,
    '{{"batch_id":"' || m.batch_id || '","events":[' || coalesce(string_agg(
      '{{' || (CASE WHEN e.id IS NULL THEN '' ELSE '"id":"' || e.id || '",' END)
      || '"event":"' || e.name || '","timestamp":' || e.timestamp_ms || ',"projectid":"' || e.project_id
      || '","orgid":"' || e.org_id || '"' || {_optional("funnelid", "e.funnel_id")}
      || {_optional("user_id", "e.user_id")} || {_optional("anonymous_id", "e.anonymous_id")}
      || {_optional("session_id", "e.session_id")} || {_optional("properties", "e.properties", "")}
      || {_optional("context", "e.context", "")} || '}}', ',' ORDER BY e.pos), '') || ']}}' AS payload
  FROM messages m LEFT JOIN message_events e ON m.message_order = e.message_order
  GROUP BY m.message_order, m.message_id, m.batch_id
)"""

_CHECKED = f"""{_MESSAGES},
checked AS (
  SELECT *, CASE WHEN name = '' THEN '{S.NAME_REQUIRED}' WHEN timestamp_ms <= 0 THEN '{S.TIMESTAMP_REQUIRED}'
    WHEN project_id = '' THEN '{S.PROJECT_REQUIRED}' WHEN org_id = '' THEN '{S.ORGANIZATION_REQUIRED}' END AS error
  FROM message_events
),
counted AS (
  SELECT m.message_order, m.message_id, m.batch_id, count(e.pos) AS total,
    count(*) FILTER (WHERE e.pos IS NOT NULL AND e.error IS NULL) AS valid
  FROM messages m LEFT JOIN checked e ON m.message_order = e.message_order
  GROUP BY m.message_order, m.message_id, m.batch_id
),
summary AS (
  SELECT message_order, message_id, batch_id, CAST(total AS INTEGER) AS total_events,
    CAST(CASE WHEN batch_id = '' THEN 0 ELSE valid END AS INTEGER) AS valid_events,
    CAST(CASE WHEN batch_id = '' THEN 0 ELSE total - valid END AS INTEGER) AS invalid_events,
    CASE WHEN batch_id = '' THEN '{S.MISSING_BATCH_ID}' WHEN total = 0 THEN '{S.EMPTY_BATCH}'
      WHEN valid = 0 THEN '{S.NO_VALID_EVENTS}' END AS reason
  FROM counted
),
survivors AS (
  SELECT e.message_order, e.message_id, e.batch_id,
    CAST(row_number() OVER (PARTITION BY e.message_order ORDER BY e.pos) - 1 AS INTEGER) AS event_index,
    coalesce(e.id, '') AS event_id, e.name, e.timestamp_ms, e.project_id, e.org_id,
    coalesce(e.funnel_id, '') AS funnel_id, e.user_id, e.anonymous_id, e.session_id,
    coalesce(e.properties, 'null') AS properties, coalesce(e.context, 'null') AS context,
    CAST(0 AS BIGINT) AS received_at_ms
  FROM checked e JOIN summary s ON e.message_order = s.message_order
  WHERE e.error IS NULL AND s.reason IS NULL
)"""


def _or_null(column: str) -> str:
    return f"""coalesce('"' || {column} || '"', 'null')"""


_EVENT_TEXT = f"""'{{' || (CASE WHEN event_id = '' THEN '' ELSE '"id":"' || event_id || '",' END)
      || '"event":"' || name || '","timestamp":' || timestamp_ms || ',"projectid":"' || project_id
      || '","orgid":"' || org_id || '","funnelid":"' || funnel_id || '","user_id":' || {_or_null("user_id")}
      || ',"anonymous_id":' || {_or_null("anonymous_id")} || ',"session_id":' || {_or_null("session_id")}
      || ',"properties":' || properties || ',"context":' || context || '}}'"""

_CONTENTS = f"""{_CHECKED},
contents AS (
  SELECT message_order, message_id, batch_id,
    '{{"batch_id":"' || batch_id || '","events":[' || string_agg({_EVENT_TEXT}, ',' ORDER BY event_index)
    || ']}}' AS canonical
  FROM survivors GROUP BY message_order, message_id, batch_id
)"""

_STATUS = f"""{_CONTENTS},
first_writers AS (
  SELECT batch_id, min(message_order) AS first_order, arg_min(canonical, message_order) AS first_canonical
  FROM contents GROUP BY batch_id
),
tagged AS (
  SELECT c.message_order, c.message_id, c.batch_id, c.canonical,
    CASE WHEN c.message_order = f.first_order THEN 'new' WHEN c.canonical = f.first_canonical THEN 'duplicate'
      ELSE 'conflict' END AS status
  FROM contents c JOIN first_writers f ON c.batch_id = f.batch_id
),
stored AS (
  SELECT s.* EXCLUDE (message_order, message_id) FROM survivors s JOIN tagged t ON s.message_order = t.message_order
  WHERE t.status = 'new'
)"""

_EVENT_COLUMNS = ", ".join(R.STORED_COLUMNS)
_STORED = f"WITH {_STATUS} SELECT {_EVENT_COLUMNS} FROM stored"
_FIRST_HASHES = f"WITH {_STATUS} SELECT batch_id, sha256(canonical) AS payload_hash FROM tagged WHERE status = 'new'"

_RAW_EVENT = """message_id, batch_id, CAST(pos AS INTEGER) AS event_index, coalesce(id, '') AS event_id, name,
  timestamp_ms, project_id, org_id, coalesce(funnel_id, '') AS funnel_id, user_id, anonymous_id, session_id,
  coalesce(properties, 'null') AS properties, coalesce(context, 'null') AS context,
  CAST(0 AS BIGINT) AS received_at_ms"""

# The derived delivery log and its leases.
_LEASES = """
log AS (
  SELECT 'm-' || user_id || '-' || (epoch_us(ts) // 86400000000) AS message_id, 'worker-' || (event_id % 12) AS consumer,
    event_type IN ('purchase', 'error') AS ack, epoch_us(ts) // 60000000 * 60000 AS at_ms FROM events
),
following AS (
  SELECT *, min(at_ms) FILTER (WHERE NOT ack) OVER later AS delivered, min(at_ms) FILTER (WHERE ack) OVER later AS acked
  FROM log WINDOW later AS (PARTITION BY message_id ORDER BY at_ms, ack, consumer
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
),
leases AS (
  SELECT message_id, consumer, at_ms AS delivered_ms, least(delivered, acked) AS ended_ms,
    CASE WHEN acked <= coalesce(delivered, acked) THEN 'acknowledged' WHEN delivered IS NOT NULL THEN 'claimed' END AS ended_by,
    CASE WHEN coalesce(least(delivered, acked) >= at_ms + 60000, true) THEN at_ms + 60000 END AS claimable_ms,
    coalesce(delivered < coalesce(acked, delivered + 1) AND delivered < at_ms + 60000, false) AS early
  FROM following WHERE NOT ack
)"""

# The derived requests, log lines and runs.
_REQUESTS = """
requests AS (
  SELECT 'run-' || (event_id % 4) AS run_id, value AS latency_ms,
    CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' THEN '500' ELSE '202' END AS status,
    length(props) * 100 AS body_bytes
  FROM events
)"""

_RUNS = """
runs AS (
  SELECT 'run-' || (event_id % 4) AS run_id, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS batches
  FROM events GROUP BY 1
)"""

_LINES = """
lines AS (
  SELECT 'run-' || (event_id % 4) AS run_id,
    CASE WHEN event_type <> 'purchase' THEN date_trunc('second', ts) END AS ts,
    CASE event_type WHEN 'click' THEN 'Worker processed batch' WHEN 'view' THEN 'Worker validated batch'
      WHEN 'signup' THEN 'Worker started' ELSE 'Worker stopped' END AS msg,
    CASE WHEN event_type <> 'error' THEN 'worker-' || (user_id % 12) END AS worker_id
  FROM events
)"""

_LINE_TEXT = """(CASE WHEN ts IS NULL THEN '' ELSE 'time="' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z" ' END)
  || 'level=info msg="' || msg || '"' || (CASE WHEN worker_id IS NULL THEN '' ELSE ' worker_id=' || worker_id END)"""

_LATENCY = f"""{_REQUESTS},
sorted AS (SELECT run_id, list_sort(list(latency_ms)) AS v, count(*) AS n FROM requests GROUP BY run_id),
latency AS (
  SELECT run_id, v[1] AS "min", v[CAST(floor((n - 1) * 0.50::DOUBLE) AS BIGINT) + 1] AS p50,
    v[CAST(floor((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95,
    v[CAST(floor((n - 1) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99, v[n] AS "max"
  FROM sorted
)"""

_OUTCOMES = """
outcomes AS (
  SELECT run_id, count(*) AS attempts, count(*) FILTER (WHERE status = '202') AS successful,
    count(*) FILTER (WHERE status IS NULL OR status <> '202') AS failed,
    CAST(sum(CASE WHEN status IS NULL THEN 0 ELSE body_bytes END) AS BIGINT) AS submitted_bytes
  FROM requests GROUP BY run_id
)"""

_DURATION = "((epoch_us(finished_at) - epoch_us(started_at)) / 1000000::DOUBLE)"
_SHOWN = "strftime({}, '%Y-%m-%d %H:%M:%S') || ' UTC'"

_REPORTS = f"""{_LATENCY}, {_OUTCOMES}, {_RUNS}, {_LINES},
codes AS (
  SELECT run_id, CAST(count(*) FILTER (WHERE status = '202') AS BIGINT) AS status_202,
    CAST(count(*) FILTER (WHERE status = '500') AS BIGINT) AS status_500
  FROM requests GROUP BY run_id
),
workers AS (
  SELECT l.run_id, l.worker_id, CAST(count(*) FILTER (WHERE msg = '{S.PROCESSED_LINE}') AS BIGINT) AS processed,
    CAST(count(*) FILTER (WHERE msg = '{S.VALIDATED_LINE}') AS BIGINT) AS validated
  FROM lines l JOIN runs r ON l.run_id = r.run_id
  WHERE l.worker_id IS NOT NULL AND l.ts >= r.started_at GROUP BY l.run_id, l.worker_id
),
by_run AS (
  SELECT run_id, CAST(count(*) AS BIGINT) AS n_workers,
    max(processed) FILTER (WHERE worker_id = 'worker-3') AS worker_3_processed,
    max(validated) FILTER (WHERE worker_id = 'worker-3') AS worker_3_validated
  FROM workers GROUP BY run_id
),
reports AS (
  SELECT r.run_id, 'stress-' || strftime(finished_at, '%Y%m%d-%H%M%S.%f') || '000.json' AS file,
    r.started_at, {_SHOWN.format("r.started_at")} AS started, {_SHOWN.format("r.finished_at")} AS finished,
    CAST(r.batches AS BIGINT) AS batches, CAST(25 AS BIGINT) AS batch_size, CAST(r.batches * 25 AS BIGINT) AS requested_events,
    o.submitted_bytes, CAST(8 AS BIGINT) AS concurrency, CAST(o.successful AS BIGINT) AS successful_requests,
    CAST(o.failed AS BIGINT) AS failed_requests, {_DURATION} AS duration_seconds,
    r.batches / {_DURATION} AS requests_per_second, (r.batches * 25) / {_DURATION} AS events_per_second,
    l."min" AS latency_min, l.p50 AS latency_p50, l.p95 AS latency_p95, l.p99 AS latency_p99,
    l."max" AS latency_max, c.status_202, c.status_500, w.n_workers, w.worker_3_processed, w.worker_3_validated
  FROM runs r JOIN outcomes o ON r.run_id = o.run_id JOIN latency l ON r.run_id = l.run_id
    JOIN codes c ON r.run_id = c.run_id JOIN by_run w ON r.run_id = w.run_id
)"""

_FILE_REPORTS = f"WITH {_REPORTS} SELECT * EXCLUDE (run_id, started_at) FROM reports"

_WORKERS = f"""WITH {_LINES} SELECT worker_id, count(*) FILTER (WHERE msg = '{S.PROCESSED_LINE}') AS processed,
  count(*) FILTER (WHERE msg = '{S.VALIDATED_LINE}') AS validated
  FROM lines WHERE worker_id IS NOT NULL GROUP BY worker_id"""

_TIME_RANGE = f"timestamp_ms BETWEEN {R.START_MS} AND {R.END_MS}"
_GROUP = "(message_order // 10) % 10"

# First failing check of a single event, before the oddities of its body.
_EVENT_ERROR = f"""CASE WHEN name = '' THEN '{S.NAME_REQUIRED}' WHEN timestamp_ms <= 0 THEN '{S.TIMESTAMP_REQUIRED}'
  WHEN project_id = '' THEN '{S.PROJECT_REQUIRED}' WHEN org_id = '' THEN '{S.ORGANIZATION_REQUIRED}' END"""

ORACLES: dict[str, str] = {
    "read_batch_messages": f"WITH {_PAYLOADS} SELECT message_id, message_order, batch_id, payload FROM payloads",
    "decode_batch": f"""WITH {_CHECKED} SELECT message_id,
        CASE WHEN {_GROUP} IN (0, 1, 3) THEN NULL WHEN {_GROUP} = 2 THEN '' ELSE batch_id END AS batch_id,
        CASE WHEN {_GROUP} IN (0, 1, 3) THEN NULL WHEN {_GROUP} = 2 THEN 0 ELSE total_events END AS total_events,
        CASE WHEN {_GROUP} IN (0, 1, 3) THEN '{S.INVALID_JSON}' END AS decode_error FROM summary""",
    "decode_event": f"""WITH {_WIRE}, judged AS (SELECT event_id,
        CASE WHEN event_id % 11 IN (1, 2, 5, 6, 8, 9) THEN '{S.INVALID_JSON}'
          WHEN event_id % 11 = 3 THEN '{S.NAME_REQUIRED}' ELSE {_EVENT_ERROR} END AS reason FROM wire)
        SELECT event_id, reason IS NULL AS accepted, reason FROM judged""",
    "write_events": _STORED,
    "write_batch_ledger": _FIRST_HASHES,
    "append_batches": f"""WITH {_CHECKED} SELECT batch_id, count(*) AS copies, CAST(sum(valid_events) AS BIGINT) AS events
        FROM summary WHERE reason IS NULL GROUP BY batch_id""",
    "read_run_reports": _FILE_REPORTS,
    "write_run_manifest": _FILE_REPORTS,
    "read_worker_log": f"""WITH {_LINES} SELECT run_id, epoch_us(ts) // 1000 AS ts_ms, worker_id, msg, count(*) AS lines
        FROM lines GROUP BY ALL""",
    "write_run_report": _FILE_REPORTS,
    "synth_batches": """WITH made AS (
        SELECT event_id + 1 AS id, epoch_us(ts) // 1000 AS now, unnest(range(4)) AS i FROM events)
        SELECT 'stress-' || now || '-' || id AS batch_id, CAST(i AS INTEGER) AS event_index,
          CASE WHEN ((id + i) % 1000) / 1000::DOUBLE < 0.3::DOUBLE THEN '' ELSE 'stress_event' END AS event,
          now AS timestamp,
          CASE WHEN ((id + i) % 1000) / 1000::DOUBLE < 0.3::DOUBLE THEN '' ELSE 'stress_project' END AS projectid,
          'stress_org' AS orgid, 'stress_funnel' AS funnelid, CAST(i AS INTEGER) AS sequence FROM made""",
    "normalize_events": f"WITH {_MESSAGES} SELECT {_RAW_EVENT} FROM message_events",
    "flatten_events": f"""WITH {_MESSAGES}
        SELECT message_id, batch_id, CAST(pos AS INTEGER) AS event_index, name FROM message_events""",
    "validate_event": f"WITH {_CHECKED} SELECT message_id, CAST(pos AS INTEGER) AS event_index, error FROM checked",
    "validate_batch": f"WITH {_CHECKED} SELECT message_id, batch_id, reason FROM summary",
    "enforce_batch_limit": f"""WITH {_CHECKED} SELECT message_id, total_events,
        CASE WHEN total_events > {R.LIMIT} THEN '{S.OVER_LIMIT}' END AS admission_error FROM summary""",
    "filter_valid_events": f"""WITH {_CHECKED}
        SELECT message_id, batch_id, event_index, name, timestamp_ms FROM survivors""",
    "rejected_events": f"""WITH {_CHECKED} SELECT message_id, batch_id, CAST(pos AS INTEGER) AS event_index, error
        FROM checked WHERE error IS NOT NULL AND batch_id <> ''""",
    "events_by_project_name": f"{_STORED} WHERE project_id = '{R.PROJECT}' AND name = '{R.NAME}'",
    "events_by_funnel": f"{_STORED} WHERE funnel_id = '{R.FUNNEL}' ORDER BY timestamp_ms",
    "events_by_properties": f"{_STORED} WHERE properties::JSON ->> '$.k' = '87'",
    "events_by_properties_indexed": f"{_STORED} WHERE properties::JSON ->> '$.k' = '87'",
    "events_by_org_time": f"{_STORED} WHERE org_id = '{R.ORG}' AND {_TIME_RANGE}",
    "events_by_user_time": f"{_STORED} WHERE user_id = '{R.USER}' ORDER BY timestamp_ms",
    "events_by_project_time": f"{_STORED} WHERE project_id = '{R.PROJECT}' AND name = '{R.NAME}' AND {_TIME_RANGE}",
    "batch_by_id": f"{_FIRST_HASHES} AND batch_id = '{R.BATCH_ID}'",
    "events_by_batch": f"""WITH {_STATUS} SELECT batch_id, event_index, name, project_id, org_id, funnel_id, properties
        FROM stored WHERE batch_id = '{R.BATCH_ID}'""",
    "log_lines_since": f"""WITH {_LINES} SELECT run_id, {_LINE_TEXT} AS line FROM lines
        WHERE ts >= TIMESTAMP '{R.SINCE}'""",
    "search_runs": f"""WITH {_REPORTS} SELECT file FROM reports
        WHERE contains(lower(started), (SELECT lower(min(started)) FROM reports))""",
    "select_run": f"""WITH {_REPORTS}, newest AS (SELECT file FROM reports ORDER BY started_at DESC, file LIMIT 1)
        SELECT 'newest' AS asked, file FROM newest UNION ALL SELECT 'unknown' AS asked, file FROM newest
        UNION ALL SELECT 'there' AS asked, min(file) AS file FROM reports""",
    "new_batches": _FIRST_HASHES,
    "new_events": f"WITH {_STATUS} SELECT batch_id, event_index, name FROM stored WHERE name = '{R.NAME}'",
    "batch_conflicts": f"WITH {_STATUS} SELECT message_id, batch_id FROM tagged WHERE status = 'conflict'",
    "conflict_places": f"""WITH {_STATUS}, texts AS (
          SELECT message_order, event_index, {_EVENT_TEXT} AS text FROM survivors
        ),
        pairs AS (
          SELECT t.message_order, t.message_id, t.batch_id, f.first_order FROM tagged t JOIN first_writers f USING (batch_id)
          WHERE status = 'conflict'
        ),
        places AS (
          SELECT p.message_order, event_index FROM pairs p JOIN texts t ON t.message_order = p.message_order
          UNION SELECT p.message_order, event_index FROM pairs p JOIN texts t ON t.message_order = p.first_order
        )
        SELECT p.message_id, p.batch_id, string_agg(l.event_index, ',' ORDER BY l.event_index) AS places
        FROM pairs p JOIN places l USING (message_order)
        LEFT JOIN texts a ON a.message_order = p.message_order AND a.event_index = l.event_index
        LEFT JOIN texts b ON b.message_order = p.first_order AND b.event_index = l.event_index
        WHERE a.text IS DISTINCT FROM b.text GROUP BY p.message_order, p.message_id, p.batch_id""",
    "batch_redeliveries": f"WITH {_STATUS} SELECT message_id, batch_id, status FROM tagged",
    "orphan_events": f"""WITH {_STATUS} SELECT batch_id, event_index FROM stored s WHERE NOT EXISTS (
        SELECT 1 FROM stored o WHERE o.batch_id = s.batch_id AND o.event_index = 0 AND o.name <> '{R.NAME}')""",
    "batch_validation_summary": f"""WITH {_CHECKED}
        SELECT message_id, batch_id, total_events, valid_events, invalid_events, reason FROM summary""",
    "stored_counts": f"""WITH {_STATUS} SELECT batch_id, CAST(1 AS BIGINT) AS batches, count(*) AS events
        FROM stored GROUP BY batch_id""",
    "daily_event_counts": f"""WITH {_STATUS} SELECT project_id, name, CAST(timestamp_ms // 86400000 AS INTEGER) AS event_day,
        count(*) AS events, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM stored GROUP BY ALL""",
    "status_code_counts": f"""WITH {_REQUESTS} SELECT run_id, status, count(*) AS n FROM requests
        WHERE status IS NOT NULL GROUP BY run_id, status""",
    "request_outcomes": f"WITH {_REQUESTS}, {_OUTCOMES} SELECT * FROM outcomes",
    "latency_summary": f"WITH {_LATENCY} SELECT * FROM latency",
    "run_throughput": f"""WITH {_RUNS} SELECT run_id, {_DURATION} AS duration_seconds,
        batches * 25 AS requested_events, batches / {_DURATION} AS requests_per_second,
        (batches * 25) / {_DURATION} AS events_per_second FROM runs""",
    "success_rate": f"""WITH {_REQUESTS}, {_OUTCOMES}
        SELECT run_id, successful::DOUBLE / attempts * 100 AS success_rate FROM outcomes""",
    "worker_counts": _WORKERS,
    "run_report": f"WITH {_REPORTS} SELECT * EXCLUDE (file, started_at) FROM reports",
    "funnel_timeline": f"""WITH {_STATUS} SELECT timestamp_ms, batch_id, event_index, name, user_id FROM stored
        WHERE funnel_id = '{R.FUNNEL}' ORDER BY timestamp_ms, batch_id, event_index""",
    "runs_newest_first": f"WITH {_REPORTS} SELECT started, file, batches FROM reports ORDER BY started_at DESC, file",
    "workers_by_name": f"{_WORKERS} ORDER BY worker_id",
    "canonical_batch_json": f"WITH {_CONTENTS} SELECT message_id, canonical FROM contents",
    "payload_hash": f"WITH {_CONTENTS} SELECT message_id, sha256(canonical) AS payload_hash FROM contents",
    "json_document": f"""WITH {_MESSAGES} SELECT message_id, CAST(pos AS INTEGER) AS event_index,
        coalesce(properties, 'null') AS properties, properties IS NULL AS no_properties,
        coalesce(context, 'null') AS context, context IS NULL AS no_context FROM message_events""",
    "json_contains": """SELECT event_id, json_contains(props, '{"k":87}') AS number,
        props::JSON ->> '$.k' = '87' AS same_number, json_contains(props, '{"k":"87"}') AS text,
        json_type(props) = 'OBJECT' AS object, json_type(props, '$.k') = 'OBJECT' AS nested,
        json_exists(props, '$.missing') AS missing, json_contains(props, '{"k":87}') AS in_array,
        event_id % 10 = 3 AS big_number FROM events""",
    "zero_defaults": f"""WITH {_MESSAGES} SELECT message_id, CAST(pos AS INTEGER) AS event_index,
        coalesce(id, '') AS event_id, coalesce(funnel_id, '') AS funnel_id, CAST(0 AS BIGINT) AS received_at_ms
        FROM message_events""",
    "epoch_millis": f"""SELECT event_id, epoch_us(ts) // 1000 AS ms, {_SHOWN.format("ts")} AS shown FROM events""",
    "format_run_date": f"""SELECT event_id, {_SHOWN.format("ts")} AS shown FROM events""",
    "two_decimals": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '0.00' ELSE printf('%.2f', value) END AS shown
        FROM events""",
    "batch_label": """SELECT event_id, 'stress-' || (epoch_us(ts) // 1000) || '-' || event_id AS label,
        'stress-' || strftime(ts, '%Y%m%d-%H%M%S.%f') || '000.json' AS report FROM events""",
    "log_fields": f"""WITH {_LINES} SELECT worker_id, msg, count(*) AS lines, count(ts) AS timed,
        max(epoch_us(ts) // 1000) AS last_ms FROM lines GROUP BY worker_id, msg""",
    "strict_json_field": f"""WITH {_WIRE} SELECT event_id,
        CASE WHEN g IN (2, 3, 5, 8) THEN NULL ELSE name END AS name, g = 5 AS bad_name,
        CASE WHEN g IN (1, 2, 3, 8) THEN NULL ELSE timestamp_ms END AS timestamp_ms, g = 1 AS bad_timestamp_ms,
        CASE WHEN g IN (2, 3, 6, 8) THEN NULL ELSE coalesce(properties, 'null') END AS properties,
        g = 6 AS bad_properties FROM (SELECT *, event_id % 11 AS g FROM wire) AS grouped""",
    "ingest_stream": _STORED,
    "lease_timeline": f"WITH {_LEASES} SELECT * FROM leases",
    "claimable_messages": f"""WITH {_LEASES} SELECT message_id, consumer, delivered_ms, claimable_ms FROM leases
        WHERE claimable_ms <= {R.CLAIM_MS} AND (ended_ms IS NULL OR ended_ms > {R.CLAIM_MS})""",
    "stream_first_writer": f"""WITH {_STATUS} SELECT message_id, batch_id,
        CASE WHEN {_GROUP} = 0 THEN 'duplicate' WHEN {_GROUP} = 5 THEN 'conflict' ELSE status END AS status FROM tagged""",
    "replay_recovery": _STORED,
    "drain": f"""WITH {_STATUS} SELECT s.message_id, s.batch_id, coalesce(t.status, 'rejected') AS status,
        s.total_events, s.valid_events, s.invalid_events
        FROM summary s LEFT JOIN tagged t ON s.message_order = t.message_order""",
    "pending_messages": f"""WITH {_STATUS} SELECT m.message_id, m.batch_id FROM messages m
        LEFT JOIN tagged t ON m.message_order = t.message_order WHERE t.status IS NULL OR t.status = 'conflict'""",
    "quarantine": f"""WITH {_STATUS}, {_PAYLOADS.removeprefix(_MESSAGES + ",")}
        SELECT s.message_id, s.batch_id, coalesce(s.reason, '{S.CONFLICT}') AS reason, p.payload
        FROM summary s JOIN payloads p ON s.message_order = p.message_order
        LEFT JOIN tagged t ON s.message_order = t.message_order
        WHERE s.reason IS NOT NULL OR t.status = 'conflict'""",
}
