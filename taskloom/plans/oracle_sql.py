"""Independent SQL for the catalogue, in the dialect of the checking engine."""

from __future__ import annotations

T = "TIMESTAMP '1998-06-15 00:00:00'"
E = "TIMESTAMP '2024-01-15 12:00:00'"
START = "TIMESTAMP '2024-01-01 00:00:00'"

# Named fragments; each lists the fragments it needs.
PARTS: dict[str, tuple[list[str], str]] = {}

PARTS["tasks"] = (
    [],
    """
  SELECT CAST(o_orderkey AS VARCHAR) AS task_id,
         'q' || CAST(o_custkey % 4 AS VARCHAR) AS queue_name,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
         o_orderdate AS created_at,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS execute_after,
         CAST(o_orderkey % 5 AS INTEGER) AS max_retries,
         '{' || CASE WHEN o_orderkey % 17 = 0 OR c_mktsegment IS NULL THEN '' ELSE '"type":"' || c_mktsegment || '",' END
             || '"data":{"operation":"'
             || CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'multiply' WHEN 2 THEN 'divide' ELSE 'power' END
             || '","a":' || CAST(o_custkey AS VARCHAR) || ',"b":' || CAST(o_orderkey % 5 AS VARCHAR) || '}}' AS payload,
         o_orderkey AS k
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
PARTS["ready"] = (
    ["tasks"],
    f"SELECT * FROM tasks WHERE created_at <= {T} AND (execute_after IS NULL OR execute_after <= {T})",
)
PARTS["delayed"] = (["tasks"], f"SELECT * FROM tasks WHERE created_at <= {T} AND execute_after > {T}")
PARTS["existing"] = (["tasks"], f"SELECT * FROM tasks WHERE created_at <= {T}")
PARTS["attempts"] = (
    [],
    """
  SELECT CAST(l_orderkey AS VARCHAR) AS task_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_quantity) AS attempt_no,
         'w' || CAST(l_suppkey AS VARCHAR) AS worker_id,
         l_shipdate AS started_at,
         l_shipdate + to_seconds(CAST(l_quantity AS BIGINT)) AS finished_at,
         l_quantity AS processing_s,
         CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS outcome,
         CASE WHEN l_returnflag = 'R' THEN 'E' || CAST(l_linenumber AS VARCHAR) END AS error
  FROM lineitem""",
)
PARTS["known"] = (
    ["attempts"],
    f"""
  SELECT task_id, attempt_no, worker_id, started_at, processing_s,
         CASE WHEN finished_at <= {T} THEN finished_at END AS finished_at,
         CASE WHEN finished_at <= {T} THEN outcome ELSE 'running' END AS outcome,
         CASE WHEN finished_at <= {T} THEN error END AS error
  FROM attempts WHERE started_at <= {T}""",
)


def plan_sql(log: str, tasks: str) -> str:
    """Terminal attempts are found by a correlated rule: a completion, or the failure that uses up the retries."""
    return f"""
  SELECT n.*,
         CASE WHEN EXISTS (SELECT 1 FROM numbered_{log} p WHERE p.task_id = n.task_id AND p.attempt_no < n.attempt_no
                           AND (p.outcome = 'completed'
                                OR (p.outcome = 'failed' AND p.failures >= p.max_retries))) THEN 'ignored'
              WHEN n.outcome <> 'failed' THEN n.outcome
              WHEN n.failures >= n.max_retries THEN 'dead' ELSE 'retry' END AS disposition
  FROM numbered_{log} n"""


def numbered_sql(log: str, tasks: str) -> str:
    return f"""
  SELECT a.*, t.queue_name, t.max_retries,
         count(*) FILTER (WHERE a.outcome = 'failed')
           OVER (PARTITION BY a.task_id ORDER BY a.attempt_no ROWS UNBOUNDED PRECEDING) AS failures
  FROM {log} a JOIN {tasks} t ON a.task_id = t.task_id"""


PARTS["numbered_known"] = (["known", "existing"], numbered_sql("known", "existing"))
PARTS["plan"] = (["numbered_known"], plan_sql("known", "existing"))
PARTS["numbered_attempts"] = (["attempts", "tasks"], numbered_sql("attempts", "tasks"))
PARTS["full_plan"] = (["numbered_attempts"], plan_sql("attempts", "tasks"))
PARTS["history"] = (
    ["plan"],
    """
  SELECT task_id,
         min(finished_at) FILTER (WHERE disposition = 'completed') AS completed_at,
         min(finished_at) FILTER (WHERE disposition = 'dead') AS dead_at,
         count(*) FILTER (WHERE disposition IN ('retry', 'dead')) AS retry_count,
         max(finished_at + to_seconds(CAST(power(2, failures) AS BIGINT))) FILTER (WHERE disposition = 'retry') AS retry_after,
         arg_max(error, attempt_no) FILTER (WHERE disposition IN ('retry', 'dead')) AS last_error,
         count(*) FILTER (WHERE disposition = 'running') AS running
  FROM plan GROUP BY task_id""",
)
PARTS["states"] = (
    ["existing", "history"],
    f"""
  SELECT t.task_id, t.queue_name, t.priority, t.created_at, t.max_retries, t.payload,
         coalesce(h.retry_after, t.execute_after) AS execute_after,
         coalesce(h.retry_count, 0) AS retry_count, h.completed_at, h.dead_at, h.last_error,
         CASE WHEN h.dead_at IS NOT NULL THEN 'dead'
              WHEN h.completed_at IS NOT NULL THEN 'completed'
              WHEN h.running > 0 THEN 'processing'
              WHEN coalesce(h.retry_after, t.execute_after) > {T} THEN 'delayed'
              ELSE 'pending' END AS state
  FROM existing t LEFT JOIN history h ON t.task_id = h.task_id""",
)
PARTS["dead"] = (["states"], "SELECT * FROM states WHERE state = 'dead'")
PARTS["ev"] = (
    [],
    """
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS task_id, 'q' || CAST(user_id % 4 AS VARCHAR) AS queue_name,
         CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'started' WHEN 'click' THEN 'extended'
                         WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS kind,
         'w' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS VARCHAR) AS worker_id,
         't' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 AS VARCHAR) AS task_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS priority,
         value / 10 AS processing_s,
         3600 * (1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 48) AS timeout_s
  FROM events""",
)
PARTS["last_move"] = (
    ["ev"],
    f"""
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM ev WHERE ts <= {E} AND kind IN ('started', 'completed', 'failed')""",
)
PARTS["leases"] = (
    ["last_move"],
    f"""
  SELECT task_id, worker_id, queue_name, ts AS lease_time, timeout_s,
         ts + to_seconds(CAST(timeout_s AS BIGINT)) AS deadline,
         {E} > ts + to_seconds(CAST(timeout_s AS BIGINT)) AS expired,
         epoch_us({E} - ts) / 1e6 AS age_s
  FROM last_move WHERE rn = 1 AND kind = 'started'""",
)
PARTS["counters"] = (
    ["existing", "plan", "states"],
    """
  SELECT queue_name, s.submitted, coalesce(started, 0) AS started, coalesce(completed, 0) AS completed,
         coalesce(failed, 0) AS failed, coalesce(retried, 0) AS retried, coalesce(dead_lettered, 0) AS dead_lettered,
         (SELECT count(*) FROM states x WHERE x.queue_name = s.queue_name AND x.state IN ('pending', 'delayed')) AS backlog
  FROM (SELECT queue_name, count(*) AS submitted FROM existing GROUP BY queue_name) s
  LEFT JOIN (SELECT queue_name,
         count(*) FILTER (WHERE disposition <> 'ignored') AS started,
         count(*) FILTER (WHERE disposition = 'completed') AS completed,
         count(*) FILTER (WHERE disposition IN ('retry', 'dead')) AS failed,
         count(*) FILTER (WHERE disposition = 'retry') AS retried,
         count(*) FILTER (WHERE disposition = 'dead') AS dead_lettered
       FROM plan GROUP BY queue_name) p USING (queue_name)""",
)
PARTS["durations"] = (
    ["attempts", "tasks"],
    """
  SELECT a.task_id, a.attempt_no, a.outcome, epoch_us(a.finished_at - a.started_at) / 1e6 AS processing_s,
         epoch_us(a.started_at - t.created_at) / 1e6 AS wait_s,
         epoch_us(a.started_at - greatest(t.created_at, coalesce(t.execute_after, t.created_at))) / 1e6 AS wait_from_due_s
  FROM attempts a JOIN tasks t ON a.task_id = t.task_id""",
)


def summary_sql(source: str, key: str, value: str) -> str:
    """Rank picks over all samples."""
    part = f"PARTITION BY {key}" if key else ""
    head = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else "HAVING count(*) > 0"
    picks = ", ".join(
        f"round(max(v) FILTER (WHERE rn = CAST(floor(n * {p}::DOUBLE) AS BIGINT) + 1), 6) AS {name}"
        for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))
    )
    return f"""
  SELECT {head}count(*) AS count, round(sum(v), 6) AS sum, round(min(v), 6) AS min, round(max(v), 6) AS max,
         round(sum(v) / count(*), 6) AS avg, {picks}
  FROM (SELECT *, row_number() OVER ({part} ORDER BY v) AS rn, count(*) OVER ({part}) AS n
        FROM (SELECT {head}{value} AS v FROM {source}) s0 WHERE v > 0) s1
  {group}"""


def clamp_sql(moves: str, name: str) -> str:
    """Running sum minus its lowest value below zero."""
    return f"""
  SELECT event_id, ts, queue_name,
         CAST(s - least(0, min(s) OVER (PARTITION BY queue_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS {name}
  FROM (SELECT event_id, ts, queue_name,
               sum(CASE WHEN kind = '{moves}' THEN 1 ELSE -1 END)
                 OVER (PARTITION BY queue_name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
        FROM ev WHERE kind IN ('{moves}', 'completed', 'failed')) x"""


PARTS["depths"] = (["ev"], clamp_sql("submitted", "depth"))
PARTS["actives"] = (["ev"], clamp_sql("started", "active"))
PARTS["page"] = (
    ["ev", "depths", "actives"],
    f"""
  SELECT (SELECT count(*) FROM ev WHERE ts <= {E} AND kind = 'submitted') AS tasks_submitted,
         (SELECT count(*) FROM ev WHERE ts <= {E} AND kind = 'completed') AS tasks_completed,
         (SELECT count(*) FROM ev WHERE ts <= {E} AND kind = 'failed') AS tasks_failed,
         epoch_us({E} - {START}) / 1e6 AS uptime_seconds,
         (SELECT 100.0 * count(*) FILTER (WHERE kind = 'completed') / count(*) FROM ev
           WHERE ts <= {E} AND kind IN ('completed', 'failed')) AS success_rate,
         (SELECT count(*) / 86400.0 FROM ev WHERE kind = 'submitted' AND ts BETWEEN {E} - INTERVAL 1 DAY AND {E}) AS submission_rate,
         (SELECT count(*) / 86400.0 FROM ev WHERE kind = 'completed' AND ts BETWEEN {E} - INTERVAL 1 DAY AND {E}) AS throughput_rate,
         (SELECT CAST(sum(d) AS BIGINT) FROM (SELECT arg_max(depth, event_id) AS d FROM depths WHERE ts <= {E} GROUP BY queue_name) x) AS queue_depth,
         (SELECT CAST(sum(d) AS BIGINT) FROM (SELECT arg_max(active, event_id) AS d FROM actives WHERE ts <= {E} GROUP BY queue_name) x) AS active_tasks,
         (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS active_workers""",
)
PARTS["times"] = (
    ["ev"],
    summary_sql(f"ev WHERE kind = 'completed' AND ts BETWEEN {E} - INTERVAL 1 DAY AND {E}", "", "processing_s"),
)
def lease_parts(p: str, end: str, rows: str) -> None:
    """Lease sessions of the chosen log rows, open ones judged at ``end``; fragment names start with ``p``."""
    PARTS[f"{p}log"] = (
        ["ev"],
        f"""
      SELECT *, count(*) FILTER (WHERE kind = 'started') OVER w AS lease_no
      FROM ev WHERE {rows} AND kind IN ('started', 'extended', 'completed', 'failed')
      WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    )
    PARTS[f"{p}opened"] = (
        [f"{p}log"],
        f"""
      SELECT task_id, lease_no, worker_id, ts AS lease_time, timeout_s,
             lead(ts) OVER (PARTITION BY task_id ORDER BY lease_no) AS next_open
      FROM {p}log WHERE kind = 'started'""",
    )
    PARTS[f"{p}closed"] = (
        [f"{p}log"],
        f"""
      SELECT task_id, lease_no, min(ts) AS finished_at FROM {p}log
      WHERE kind IN ('completed', 'failed') AND lease_no > 0 GROUP BY task_id, lease_no""",
    )
    PARTS[f"{p}moves"] = (
        [f"{p}log", f"{p}opened", f"{p}closed"],
        f"""
      SELECT l.task_id, l.lease_no, l.ts, l.kind, o.lease_time, o.timeout_s,
             l.kind = 'extended' AND l.worker_id = o.worker_id AS extends,
             count(*) FILTER (WHERE l.kind = 'extended' AND l.worker_id = o.worker_id)
               OVER (PARTITION BY l.task_id, l.lease_no ORDER BY l.ts, l.event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
      FROM {p}log l JOIN {p}opened o ON l.task_id = o.task_id AND l.lease_no = o.lease_no
      LEFT JOIN {p}closed c ON l.task_id = c.task_id AND l.lease_no = c.lease_no
      WHERE l.kind <> 'started' AND (c.finished_at IS NULL OR l.ts <= c.finished_at)""",
    )
    PARTS[f"{p}sessions"] = (
        [f"{p}opened", f"{p}closed", f"{p}moves"],
        f"""
      SELECT o.task_id, o.lease_no, o.worker_id, o.lease_time, coalesce(m.extensions, 0) AS extensions,
             coalesce(m.missed, o.lease_time + to_seconds(o.timeout_s + 300 * coalesce(m.extensions, 0))) AS deadline,
             coalesce(c.finished_at, o.next_open) AS ended_at,
             coalesce(m.missed,
                      CASE WHEN coalesce(c.finished_at, o.next_open, {end}) > o.lease_time + to_seconds(o.timeout_s + 300 * coalesce(m.extensions, 0))
                           THEN o.lease_time + to_seconds(o.timeout_s + 300 * coalesce(m.extensions, 0)) END) AS expired_at
      FROM {p}opened o
      LEFT JOIN {p}closed c ON o.task_id = c.task_id AND o.lease_no = c.lease_no
      LEFT JOIN (SELECT task_id, lease_no, count(*) FILTER (WHERE extends) AS extensions,
                        min(lease_time + to_seconds(timeout_s + 300 * earlier))
                          FILTER (WHERE ts > lease_time + to_seconds(timeout_s + 300 * earlier)) AS missed
                 FROM {p}moves GROUP BY task_id, lease_no) m
        ON o.task_id = m.task_id AND o.lease_no = m.lease_no""",
    )


lease_parts("", E, f"ts <= {E}")
PARTS["handlers"] = (
    [],
    """
  SELECT * FROM (VALUES ('AUTOMOBILE', 'math'), ('BUILDING', 'math'), ('HOUSEHOLD', 'math'),
                        ('FURNITURE', 'simple'), ('default', 'simple')) v(task_type, handler_kind)""",
)
PARTS["fields"] = (
    ["tasks"],
    """
  SELECT *, coalesce(json_extract_string(payload, '$.type'), 'default') AS task_type,
         CAST(json_extract(payload, '$.data') AS VARCHAR) AS data,
         json_extract_string(payload, '$.data.operation') AS op,
         CAST(json_extract_string(payload, '$.data.a') AS DOUBLE) AS a,
         CAST(json_extract_string(payload, '$.data.b') AS DOUBLE) AS b
  FROM tasks""",
)
PARTS["handled"] = (
    ["fields", "handlers"],
    f"""
  SELECT *, CASE WHEN error IS NOT NULL THEN NULL
                 WHEN handler_kind = 'simple' THEN 'Processed: ' || data
                 ELSE format('{{:.6f}}', CASE op WHEN 'add' THEN a + b WHEN 'multiply' THEN a * b ELSE a / b END) END AS result
  FROM (SELECT f.*, h.handler_kind,
               CASE WHEN h.handler_kind IS NULL THEN 'No handler registered for task type: ' || f.task_type
                    WHEN h.handler_kind = 'simple' THEN NULL
                    WHEN op = 'divide' AND b = 0 THEN 'Division by zero'
                    WHEN op NOT IN ('add', 'multiply', 'divide') THEN 'Unknown operation: ' || op END AS error
        FROM fields f LEFT JOIN handlers h ON f.task_type = h.task_type
        WHERE created_at <= {T} AND (execute_after IS NULL OR execute_after <= {T})) x""",
)
PARTS["health"] = (
    ["counters", "states", "plan"],
    """
  SELECT queue_name, success_rate, queue_depth, p95, active_workers,
         CASE WHEN queue_depth > 1000 OR success_rate < 95 OR (active_workers = 0 AND queue_depth > 0)
              THEN 'unhealthy' ELSE 'healthy' END AS status,
         CASE WHEN queue_depth < 1000 THEN 'ok' ELSE 'warning' END AS check_queue_depth,
         CASE WHEN success_rate >= 95 THEN 'ok' ELSE 'warning' END AS check_success_rate,
         CASE WHEN active_workers > 0 OR queue_depth = 0 THEN 'ok' ELSE 'critical' END AS check_workers,
         CASE WHEN p95 IS NULL OR p95 < 10 THEN 'ok' ELSE 'warning' END AS check_processing_time,
         concat_ws('; ',
           CASE WHEN queue_depth > 1000 THEN 'High queue depth: ' || CAST(queue_depth AS VARCHAR) END,
           CASE WHEN success_rate < 95 THEN 'Low success rate: ' || format('{:.1f}', success_rate) || '%' END,
           CASE WHEN active_workers = 0 AND queue_depth > 0 THEN 'No active workers with pending tasks' END,
           CASE WHEN p95 > 10 THEN 'High p95 processing time: ' || format('{:.2f}', p95) || 's' END) AS warnings
  FROM (SELECT c.queue_name,
               coalesce(100.0::DOUBLE * c.completed / nullif(c.completed + c.failed, 0), 100.0::DOUBLE) AS success_rate,
               s.queue_depth, p.p95, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS active_workers
        FROM counters c
        LEFT JOIN (SELECT queue_name, count(*) FILTER (WHERE state IN ('pending', 'delayed')) AS queue_depth
                   FROM states GROUP BY queue_name) s ON c.queue_name = s.queue_name
        LEFT JOIN (SELECT queue_name, max(processing_s) FILTER (WHERE rn = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1) AS p95
                   FROM (SELECT queue_name, processing_s,
                                row_number() OVER (PARTITION BY queue_name ORDER BY processing_s) AS rn,
                                count(*) OVER (PARTITION BY queue_name) AS n
                         FROM plan WHERE disposition = 'completed') r GROUP BY queue_name) p
          ON c.queue_name = p.queue_name) m""",
)
PARTS["docs"] = (
    ["tasks"],
    """
  SELECT task_id AS submission_id,
         '{' || concat_ws(',',
           CASE WHEN k % 29 <> 0 THEN '"priority":' || CAST(CASE WHEN k % 11 = 0 THEN -1 WHEN k % 11 = 1 THEN 101 ELSE priority END AS VARCHAR) END,
           '"payload":' || CASE WHEN k % 19 = 0 THEN '"text"' ELSE payload END,
           CASE WHEN k % 7 <> 0 THEN '"max_retries":' || CAST(CASE WHEN k % 13 = 0 THEN 11 ELSE max_retries END AS VARCHAR) END,
           '"execute_after":"' || CASE WHEN k % 31 = 0 THEN 'soon' ELSE strftime(execute_after, '%Y-%m-%dT%H:%M:%S') END || '"')
         || CASE WHEN k % 23 = 0 THEN '' ELSE '}' END AS doc
  FROM tasks""",
)
PARTS["stored"] = (
    ["tasks"],
    """
  SELECT task_id AS stored_key, k,
         '{' || concat_ws(',', '"task_id":"' || task_id || '"', '"priority":' || CAST(priority AS VARCHAR),
           '"payload":' || payload, '"created_at":' || CAST(CAST(epoch_us(created_at) / 1e6 AS DECIMAL(20,6)) AS VARCHAR),
           CASE WHEN k % 2 = 0 THEN '"execute_after":' || CAST(CAST(epoch_us(execute_after) / 1e6 AS DECIMAL(20,6)) AS VARCHAR) END,
           CASE WHEN k % 2 = 1 THEN '"retry_count":' || CAST(k % 4 AS VARCHAR) END,
           CASE WHEN k % 7 <> 0 THEN '"max_retries":' || CAST(max_retries AS VARCHAR) END,
           CASE WHEN k % 5 <> 0 THEN '"status":"completed"' END)
         || CASE WHEN k % 23 = 0 THEN '' ELSE '}' END AS doc
  FROM tasks""",
)


def with_parts(needs: list[str], body: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    ctes = ",\n".join(f"{name} AS ({PARTS[name][1]}\n)" for name in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


ORACLE: dict[str, str] = {}


def oracle(name: str, needs: list[str], body: str) -> None:
    ORACLE[name] = with_parts(needs, body)


TASK = "task_id, queue_name, priority, created_at, execute_after, max_retries"

oracle("task_scan", ["tasks"], f"SELECT {TASK}, payload, 0 AS retry_count, 'pending' AS status FROM tasks")
oracle(
    "submit_validate",
    ["docs"],
    """
SELECT submission_id, reason IS NULL AS accepted, reason, priority, max_retries,
       TRY_CAST(due AS TIMESTAMP) AS execute_after,
       CASE WHEN ptype = 'OBJECT' THEN coalesce(json_extract_string(safe, '$.payload.type'), 'default') END AS task_type
FROM (SELECT *, CASE WHEN NOT ok THEN 'malformed'
                     WHEN priority IS NULL OR priority NOT BETWEEN 0 AND 100 THEN 'priority'
                     WHEN ptype IS DISTINCT FROM 'OBJECT' THEN 'payload'
                     WHEN max_retries NOT BETWEEN 0 AND 10 THEN 'max_retries'
                     WHEN due IS NOT NULL AND TRY_CAST(due AS TIMESTAMP) IS NULL THEN 'execute_after' END AS reason
      FROM (SELECT *, CAST(json_extract_string(safe, '$.priority') AS INTEGER) AS priority,
                   CAST(coalesce(json_extract_string(safe, '$.max_retries'), '3') AS INTEGER) AS max_retries,
                   json_type(safe, '$.payload') AS ptype,
                   json_extract_string(safe, '$.execute_after') AS due
            FROM (SELECT *, json_valid(doc) AS ok, CASE WHEN json_valid(doc) THEN doc ELSE '{}' END AS safe FROM docs) a) b) c""",
)
oracle(
    "task_encode",
    ["tasks"],
    """
SELECT task_id,
       '{"task_id":"' || task_id || '","priority":' || CAST(priority AS VARCHAR)
       || ',"payload":{"data":{"a":' || CAST(json_extract(payload, '$.data.a') AS VARCHAR)
       || ',"b":' || CAST(json_extract(payload, '$.data.b') AS VARCHAR)
       || ',"operation":"' || json_extract_string(payload, '$.data.operation') || '"}'
       || coalesce(',"type":"' || json_extract_string(payload, '$.type') || '"', '') || '}'
       || ',"created_at":' || CAST(CAST(epoch_us(created_at) / 1e6 AS DECIMAL(20,6)) AS VARCHAR)
       || ',"execute_after":' || coalesce(CAST(CAST(epoch_us(execute_after) / 1e6 AS DECIMAL(20,6)) AS VARCHAR), 'null')
       || ',"retry_count":0,"max_retries":' || CAST(max_retries AS VARCHAR) || ',"status":"pending"}' AS doc
FROM tasks""",
)
oracle(
    "task_decode",
    ["stored"],
    """
SELECT stored_key, NOT ok AS quarantined,
       json_extract_string(safe, '$.task_id') AS task_id,
       CAST(json_extract_string(safe, '$.priority') AS INTEGER) AS priority,
       CAST(json_extract(safe, '$.payload') AS VARCHAR) AS payload,
       make_timestamp(CAST(round(CAST(json_extract_string(safe, '$.created_at') AS DOUBLE) * 1e6) AS BIGINT)) AS created_at,
       make_timestamp(CAST(round(CAST(json_extract_string(safe, '$.execute_after') AS DOUBLE) * 1e6) AS BIGINT)) AS execute_after,
       CASE WHEN ok THEN CAST(coalesce(json_extract_string(safe, '$.retry_count'), '0') AS INTEGER) END AS retry_count,
       CASE WHEN ok THEN CAST(coalesce(json_extract_string(safe, '$.max_retries'), '3') AS INTEGER) END AS max_retries,
       CASE WHEN ok THEN coalesce(json_extract_string(safe, '$.status'), 'pending') END AS status,
       CASE WHEN NOT ok THEN doc END AS raw
FROM (SELECT *, json_valid(doc) AS ok, CASE WHEN json_valid(doc) THEN doc ELSE '{}' END AS safe FROM stored) a""",
)
oracle(
    "namespaced_queue",
    ["tasks"],
    "SELECT queue_name || ':' || task_id AS namespaced_key, queue_name, priority, created_at FROM tasks",
)
oracle("dlq_sink", ["dead"], "SELECT task_id, queue_name, retry_count, last_error, dead_at FROM dead")
oracle(
    "prometheus_export",
    ["page", "times"],
    """
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM (
    SELECT ['# HELP tasks_submitted_total Total number of tasks submitted', '# TYPE tasks_submitted_total counter',
            'tasks_submitted_total ' || tasks_submitted,
            '# HELP tasks_completed_total Total number of tasks completed', '# TYPE tasks_completed_total counter',
            'tasks_completed_total ' || tasks_completed,
            '# HELP tasks_failed_total Total number of tasks failed', '# TYPE tasks_failed_total counter',
            'tasks_failed_total ' || tasks_failed,
            '# HELP queue_depth Current number of tasks in queue', '# TYPE queue_depth gauge', 'queue_depth ' || queue_depth,
            '# HELP active_workers Number of active workers', '# TYPE active_workers gauge', 'active_workers ' || active_workers,
            '# HELP throughput_rate Current throughput in tasks per second', '# TYPE throughput_rate gauge',
            'throughput_rate ' || format('{:.4f}', throughput_rate::DOUBLE)]
           || CASE WHEN t.count > 0 THEN
           ['# HELP task_processing_seconds Task processing time in seconds', '# TYPE task_processing_seconds summary',
            'task_processing_seconds{quantile="0.5"} ' || format('{:.4f}', t.p50),
            'task_processing_seconds{quantile="0.95"} ' || format('{:.4f}', t.p95),
            'task_processing_seconds{quantile="0.99"} ' || format('{:.4f}', t.p99),
            'task_processing_seconds_sum ' || format('{:.4f}', t.sum),
            'task_processing_seconds_count ' || t.count] ELSE [] END AS lines
    FROM page LEFT JOIN times t ON true) x) y""",
)
oracle(
    "metrics_snapshot_row",
    ["page", "times"],
    """
SELECT tasks_submitted, tasks_completed, tasks_failed, uptime_seconds, round(success_rate, 6) AS success_rate,
       round(submission_rate::DOUBLE, 6) AS submission_rate, round(throughput_rate::DOUBLE, 6) AS throughput_rate,
       queue_depth, active_tasks, active_workers,
       t.count AS processing_count, t.sum AS processing_sum, t.avg AS processing_avg, t.min AS processing_min,
       t.max AS processing_max, t.p50 AS processing_p50, t.p95 AS processing_p95, t.p99 AS processing_p99
FROM page LEFT JOIN times t ON true""",
)
oracle(
    "completed_retention",
    ["states"],
    f"""SELECT task_id, queue_name, state, completed_at FROM states
WHERE NOT (state = 'completed' AND completed_at + to_days(30) < {T})""",
)
oracle(
    "versioned_retention",
    ["states"],
    f"""SELECT task_id, queue_name, state, completed_at FROM states
WHERE queue_name <> 'q1' AND NOT (state = 'completed' AND completed_at + to_days(30) < {T})""",
)
oracle(
    "purge_report",
    ["states"],
    """
SELECT queue_name, count(*) FILTER (WHERE state IN ('pending', 'delayed')) AS tasks_cleared,
       count(*) FILTER (WHERE state = 'dead') AS dead_letters_cleared
FROM states GROUP BY queue_name""",
)
oracle("ready_filter", ["ready"], f"SELECT {TASK} FROM ready")
oracle("payload_route_fields", ["fields"], "SELECT task_id, task_type, data FROM fields")
oracle(
    "task_view",
    ["tasks"],
    """
SELECT task_id, priority, 'pending' AS status, epoch_us(created_at) / 1e6 AS created_at,
       epoch_us(execute_after) / 1e6 AS execute_after, 0 AS retry_count, max_retries, payload
FROM tasks""",
)
oracle("derived_state", ["states"], "SELECT task_id, queue_name, state, retry_count, execute_after FROM states")
oracle(
    "transition_audit",
    ["ev"],
    """
SELECT event_id, task_id, kind, state_before,
       CASE WHEN kind = 'submitted' THEN CASE WHEN state_before IN ('submitted', 'started') THEN 'submitted_while_open' ELSE 'ok' END
            WHEN kind = 'started' THEN CASE WHEN state_before = 'started' THEN 'started_twice' ELSE 'ok' END
            WHEN state_before = 'started' THEN 'ok'
            WHEN kind = 'extended' THEN 'extended_without_lease'
            WHEN state_before = 'completed' AND kind = 'completed' THEN 'completed_twice'
            WHEN state_before = 'completed' THEN 'failed_after_completed'
            ELSE 'finished_without_start' END AS verdict
FROM (SELECT *, last_value(CASE WHEN kind <> 'extended' THEN kind END IGNORE NULLS)
               OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_before
      FROM ev) x""",
)
oracle(
    "lease_expired_filter",
    ["leases"],
    "SELECT task_id, worker_id, queue_name, lease_time, timeout_s FROM leases WHERE expired",
)
oracle(
    "lease_time_remaining",
    ["leases"],
    f"""SELECT task_id, worker_id, round(greatest(0, epoch_us(deadline - {E}) / 1e6), 6) AS remaining_s, deadline, expired
FROM leases""",
)
oracle(
    "lease_near_expiry",
    ["leases"],
    "SELECT task_id, worker_id, round(age_s, 6) AS age_s, expired FROM leases WHERE age_s > 0.8 * timeout_s",
)
oracle(
    "positive_samples", ["durations"], "SELECT task_id, attempt_no, wait_s, processing_s FROM durations WHERE wait_s > 0"
)
oracle(
    "dlq_page",
    ["dead"],
    "SELECT task_id, queue_name, retry_count, dead_at FROM dead ORDER BY dead_at, task_id LIMIT 100 OFFSET 50",
)
oracle(
    "stale_filter",
    ["states"],
    f"""SELECT task_id, queue_name, priority, epoch_us({T} - created_at) / 1e6 AS age_s, 'pending' AS status
FROM states WHERE state = 'processing' AND epoch_us({T} - created_at) / 1e6 > 300""",
)
oracle(
    "detail_lookup",
    ["existing"],
    """SELECT task_id, priority, payload FROM existing
WHERE task_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)""",
)
oracle(
    "handler_route_join",
    ["fields", "handlers"],
    f"""
SELECT f.task_id, f.task_type, h.handler_kind,
       CASE WHEN h.handler_kind IS NULL THEN 'No handler registered for task type: ' || f.task_type END AS error
FROM fields f LEFT JOIN handlers h ON f.task_type = h.task_type
WHERE created_at <= {T} AND (execute_after IS NULL OR execute_after <= {T})""",
)
oracle(
    "lookup_with_dlq_fallback",
    ["states", "tasks"],
    """
SELECT t.task_id, CASE WHEN s.state IN ('pending', 'delayed', 'processing') THEN 'live'
                       WHEN s.state = 'dead' THEN 'dlq' ELSE 'not_found' END AS source,
       s.queue_name, s.state, s.retry_count
FROM tasks t LEFT JOIN states s ON t.task_id = s.task_id AND s.state <> 'completed'""",
)
oracle(
    "lease_action_check",
    ["ev", "leases"],
    f"""
SELECT e.event_id, e.task_id, e.worker_id, CASE WHEN e.kind = 'extended' THEN 'extend' ELSE 'release' END AS action,
       l.worker_id AS holder,
       CASE WHEN l.task_id IS NULL THEN 'not_found' WHEN l.worker_id <> e.worker_id THEN 'wrong_worker' ELSE 'ok' END AS outcome
FROM ev e LEFT JOIN leases l ON e.task_id = l.task_id
WHERE e.ts > {E} AND e.kind IN ('extended', 'completed', 'failed')""",
)
oracle(
    "lease_conflicts",
    ["ev", "leases"],
    f"""
SELECT e.event_id, e.task_id, e.worker_id, l.worker_id AS holder,
       CASE WHEN l.task_id IS NULL THEN 'acquired' WHEN e.ts > l.deadline THEN 'override_expired' ELSE 'conflict' END AS outcome
FROM ev e LEFT JOIN leases l ON e.task_id = l.task_id WHERE e.ts > {E} AND e.kind = 'started'""",
)
oracle(
    "visible_tasks",
    ["ready", "attempts"],
    f"""SELECT {TASK} FROM ready WHERE task_id NOT IN
(SELECT task_id FROM attempts WHERE started_at <= {T} AND finished_at > {T} AND started_at + to_seconds(300) >= {T})""",
)
oracle(
    "apply_completions",
    ["ev", "leases"],
    f"""
SELECT task_id, worker_id, CASE WHEN task_id IN
         (SELECT task_id FROM ev WHERE kind = 'completed' AND ts > {E})
       THEN 'completed' ELSE 'processing' END AS disposition
FROM leases""",
)
oracle(
    "attempt_durations",
    ["durations"],
    "SELECT task_id, attempt_no, outcome, processing_s, wait_s, wait_from_due_s FROM durations",
)
oracle(
    "event_attempts",
    ["ev"],
    """
SELECT task_id, attempt_no, worker_id, ts AS started_at,
       CASE WHEN next_kind <> 'started' THEN next_ts END AS finished_at,
       CASE WHEN next_kind <> 'started' THEN next_kind END AS outcome,
       CASE WHEN next_kind <> 'started' THEN round(epoch_us(next_ts - ts) / 1e6, 6) END AS processing_s
FROM (SELECT *, count(*) FILTER (WHERE kind = 'started') OVER (w ROWS UNBOUNDED PRECEDING) AS attempt_no,
             lead(kind) OVER w AS next_kind, lead(ts) OVER w AS next_ts
      FROM ev WHERE kind IN ('started', 'completed', 'failed')
      WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)) x
WHERE kind = 'started'""",
)
oracle(
    "type_failure_rate",
    ["ev"],
    """
SELECT t.task_type, coalesce(s.tasks, 0) AS tasks, coalesce(f.failures, 0) AS failures,
       coalesce(round(100.0::DOUBLE * f.failures / s.tasks, 6), 0) AS failure_rate
FROM (SELECT DISTINCT task_type FROM ev) t
LEFT JOIN (SELECT task_type, count(*) AS tasks FROM ev WHERE kind = 'submitted' GROUP BY task_type) s USING (task_type)
LEFT JOIN (SELECT task_type, count(*) AS failures FROM ev WHERE kind = 'failed' GROUP BY task_type) f USING (task_type)""",
)
oracle("lifecycle_counters", ["counters"], "SELECT * FROM counters")
oracle(
    "counts_by_type",
    ["ev"],
    """SELECT task_type, count(*) FILTER (WHERE kind = 'submitted') AS tasks,
count(*) FILTER (WHERE kind = 'failed') AS failures FROM ev GROUP BY task_type""",
)
oracle(
    "counts_by_type_priority",
    ["ev"],
    """SELECT task_type, priority, count(*) FILTER (WHERE kind = 'submitted') AS tasks,
count(*) FILTER (WHERE kind = 'failed') AS failures FROM ev GROUP BY task_type, priority""",
)
oracle(
    "queue_stats",
    ["states"],
    """
SELECT queue_name, count(*) FILTER (WHERE state = 'pending') AS pending,
       count(*) FILTER (WHERE state = 'processing') AS processing,
       count(*) FILTER (WHERE state = 'delayed') AS delayed,
       count(*) FILTER (WHERE state = 'dead') AS dead_letters, count(*) AS total_tasks,
       count(*) FILTER (WHERE state IN ('pending', 'delayed')) AS backlog
FROM states GROUP BY queue_name""",
)
oracle(
    "queue_size",
    ["states"],
    "SELECT queue_name, count(*) FILTER (WHERE state IN ('pending', 'delayed')) AS queue_size FROM states GROUP BY queue_name",
)
oracle("metric_summary", ["ev"], summary_sql("ev WHERE kind = 'completed'", "task_type", "processing_s"))
oracle("wait_summary", ["durations"], summary_sql("durations", "", "wait_s"))
oracle(
    "success_rate",
    ["counters"],
    """SELECT queue_name, completed, failed,
round(coalesce(100.0::DOUBLE * completed / nullif(completed + failed, 0), 100.0::DOUBLE), 6) AS success_rate FROM counters""",
)
BUCKETS = """(VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25),
 ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('5', 5), ('10', 10), ('30', 30), ('60', 60), ('+Inf', 1e300)) b(le, bound)"""
oracle(
    "latency_histogram",
    ["durations"],
    f"""
SELECT metric, le, count(*) FILTER (WHERE v <= CAST(bound AS DOUBLE)) AS cumulative, round(sum(v), 6) AS sum, count(*) AS count
FROM (SELECT 'processing' AS metric, processing_s AS v FROM durations WHERE processing_s > 0
      UNION ALL SELECT 'wait', wait_s FROM durations WHERE wait_s > 0) s, {BUCKETS}
GROUP BY metric, le""",
)
oracle(
    "event_latency_histogram",
    ["ev"],
    f"""
SELECT 'processing' AS metric, le, count(*) FILTER (WHERE processing_s <= CAST(bound AS DOUBLE)) AS cumulative,
       round(sum(processing_s), 6) AS sum, count(*) AS count
FROM ev, {BUCKETS} WHERE kind = 'completed' AND processing_s > 0 GROUP BY le""",
)
EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 1e300)
UP_TO = ", ".join(f"count(*) FILTER (WHERE v <= {e}::DOUBLE)" for e in EDGES)
oracle(
    "rollup_totals",
    ["ev"],
    f"""
SELECT task_type, count(*) FILTER (WHERE kind = 'submitted') AS submitted, count(*) FILTER (WHERE kind = 'started') AS started,
       count(*) FILTER (WHERE kind = 'completed') AS completed, count(*) FILTER (WHERE kind = 'failed') AS failed, count(v) AS samples,
       round(sum(v), 6) AS total_s, round(min(v), 6) AS low_s, round(max(v), 6) AS high_s, concat_ws(',', {UP_TO}) AS cumulative
FROM (SELECT *, CASE WHEN kind = 'completed' AND processing_s > 0 THEN processing_s END AS v FROM ev) x GROUP BY task_type""",
)
oracle(
    "lease_stats",
    ["leases"],
    """
SELECT count(*) AS active_leases, count(*) FILTER (WHERE expired) AS expired_leases,
       round(coalesce(avg(age_s) FILTER (WHERE NOT expired), 0), 6) AS avg_lease_s,
       round(coalesce(max(age_s) FILTER (WHERE NOT expired), 0), 6) AS max_lease_s
FROM leases""",
)
oracle("lease_effective_deadline", ["sessions"], "SELECT * FROM sessions")
oracle(
    "lease_counters",
    ["sessions"],
    """
SELECT count(*) FILTER (WHERE ended_at IS NULL AND expired_at IS NULL) AS active_leases,
       count(expired_at) AS lease_expirations_total, CAST(coalesce(sum(extensions), 0) AS BIGINT) AS lease_extensions_total
FROM sessions""",
)
WORKERS = """
SELECT 'w' || CAST(s_suppkey AS VARCHAR) AS worker_id, CAST(1 + s_suppkey % 20 AS INTEGER) AS max_workers,
       s_acctbal > 0 AS running FROM supplier"""
PARTS["worker_rows"] = (
    ["ev", "leases"],
    f"""
  SELECT w.worker_id, w.max_workers, w.running, coalesce(a.n, 0) AS active_tasks, coalesce(h.types, '') AS handlers
  FROM ({WORKERS}) w
  LEFT JOIN (SELECT worker_id, count(*) AS n FROM leases GROUP BY worker_id) a ON w.worker_id = a.worker_id
  LEFT JOIN (SELECT worker_id, string_agg(DISTINCT task_type, ',' ORDER BY task_type) AS types
             FROM ev WHERE kind = 'started' GROUP BY worker_id) h ON w.worker_id = h.worker_id""",
)
oracle("worker_stats", ["worker_rows"], "SELECT * FROM worker_rows")
oracle(
    "pool_stats",
    ["worker_rows"],
    """
SELECT count(*) AS total_workers, count(*) FILTER (WHERE running) AS running_workers,
       CAST(sum(max_workers) AS BIGINT) AS total_slots, CAST(sum(active_tasks) AS BIGINT) AS active_tasks FROM worker_rows""",
)
oracle(
    "load_distribution",
    [],
    """
SELECT 'w' || CAST(s_suppkey AS VARCHAR) AS worker_id, coalesce(n, 0) AS processed,
       round(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R'), 9) AS share
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey) l
  ON s_suppkey = l_suppkey""",
)
oracle(
    "health_status",
    ["health"],
    """SELECT queue_name, round(success_rate, 6) AS success_rate, queue_depth, p95, active_workers, status,
check_queue_depth, check_success_rate, check_workers, check_processing_time, warnings FROM health""",
)
oracle(
    "check_titles",
    ["health"],
    """
SELECT queue_name, 'Queue Depth' AS title, upper(check_queue_depth) AS verdict FROM health
UNION ALL SELECT queue_name, 'Success Rate', upper(check_success_rate) FROM health
UNION ALL SELECT queue_name, 'Workers', upper(check_workers) FROM health
UNION ALL SELECT queue_name, 'Processing Time', upper(check_processing_time) FROM health""",
)
oracle(
    "dlq_summary",
    ["dead"],
    """
SELECT coalesce(json_extract_string(payload, '$.type'), 'default') AS task_type, last_error AS error,
       count(*) AS dead_letters, max(retry_count) AS max_attempts, max(dead_at) AS latest_dead_at,
       arg_max(task_id, (dead_at, task_id)) AS latest_task
FROM dead GROUP BY ALL""",
)


def rates_sql(width: str, seconds: str, suffix: str) -> str:
    recent = f"ts >= {E} - {width}"
    return f"""round(count(*) FILTER (WHERE {recent} AND kind = 'submitted')::DOUBLE / {seconds}, 9) AS submission_rate{suffix},
       round(count(*) FILTER (WHERE {recent} AND kind = 'completed')::DOUBLE / {seconds}, 9) AS throughput_rate{suffix}"""


oracle(
    "submission_throughput_rate",
    ["ev"],
    f"""
SELECT queue_name, {rates_sql("INTERVAL 60 SECOND", "60.0", "")},
       {rates_sql("INTERVAL 1 DAY", "86400.0", "_day")}
FROM ev WHERE ts <= {E} GROUP BY queue_name""",
)
URGENCY = "priority, created_at, task_id"
oracle(
    "dispatch_order",
    ["ready"],
    f"""SELECT task_id, queue_name, priority,
row_number() OVER (PARTITION BY queue_name ORDER BY {URGENCY}) AS position FROM ready""",
)


def rolling_sql(source: str, value: str) -> str:
    frame = "w AS (PARTITION BY queue_name ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)"
    return f"""
SELECT DISTINCT queue_name, ts, count({value}) OVER w AS count, round(sum({value}) OVER w, 6) AS sum,
       round(min({value}) OVER w, 6) AS min, round(max({value}) OVER w, 6) AS max,
       round(sum({value}) OVER w / count({value}) OVER w, 6) AS avg
FROM {source} WINDOW {frame}"""


oracle("rolling_summary", ["ev"], rolling_sql("ev", "processing_s"))
oracle(
    "queue_depth_rolling",
    ["depths"],
    f"SELECT queue_name, ts, min, max, avg FROM ({rolling_sql('depths', 'CAST(depth AS DOUBLE)')}) r",
)
oracle(
    "rolling_rate",
    ["ev"],
    f"""
SELECT queue_name, ts, count, round(count / least(60.0::DOUBLE, epoch_us(ts - {START}) / 1e6), 9) AS rate
FROM (SELECT queue_name, ts, count(*) OVER (PARTITION BY queue_name ORDER BY ts
        RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS count
      FROM ev WHERE kind = 'submitted') r""",
)
oracle("queue_depth_timeline", ["depths"], "SELECT event_id, queue_name, depth FROM depths")
oracle("active_task_timeline", ["actives"], "SELECT event_id, queue_name, active FROM actives")
oracle(
    "recent_errors",
    ["plan"],
    """
SELECT queue_name, recency, task_id, attempt_no, error,
       CASE WHEN length(error) > 60 THEN substr(error, 1, 60) || '...' ELSE error END AS shown
FROM (SELECT queue_name, task_id, attempt_no,
             'attempt ' || attempt_no || ' of task ' || task_id || ' failed on worker ' || worker_id || ' with error code ' || error AS error,
             row_number() OVER (PARTITION BY queue_name ORDER BY finished_at DESC, task_id DESC, attempt_no DESC) AS recency
      FROM plan WHERE disposition IN ('retry', 'dead')) x
WHERE recency <= 100""",
)
oracle(
    "rate_limit_audit",
    ["ev"],
    """
SELECT event_id, queue_name, round(gap, 6) AS gap_s, coalesce(gap < 600, false) AS too_early
FROM (SELECT event_id, queue_name,
             epoch_us(ts - lag(ts) OVER (PARTITION BY queue_name ORDER BY ts, event_id)) / 1e6 AS gap
      FROM ev WHERE kind = 'started') x""",
)
oracle(
    "rate_limited_schedule",
    ["ready"],
    """
SELECT task_id, queue_name, ready_at, release_no,
       make_timestamp(CAST(max(epoch_us(ready_at) - release_no * 200000)
         OVER (PARTITION BY queue_name ORDER BY release_no ROWS UNBOUNDED PRECEDING) + release_no * 200000 AS BIGINT)) AS release_at
FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY ready_at, priority, task_id) AS release_no
      FROM (SELECT *, greatest(created_at, coalesce(execute_after, created_at)) AS ready_at FROM ready) r0) r1""",
)
oracle(
    "retry_plan",
    ["full_plan"],
    """
SELECT task_id, attempt_no, failures AS retry_count, disposition,
       CASE WHEN disposition = 'retry' THEN power(2, failures) END AS backoff_s,
       CASE WHEN disposition = 'retry' THEN finished_at + to_seconds(CAST(power(2, failures) AS BIGINT)) END AS next_execute_after,
       error
FROM full_plan WHERE outcome = 'failed'""",
)
oracle(
    "current_task_state",
    ["ev"],
    f"""
SELECT task_id, kind, ts, event_id, worker_id, task_type, priority
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev WHERE ts <= {E}) x
WHERE rn = 1""",
)
oracle(
    "capacity_admission",
    ["tasks", "states"],
    f"""
SELECT task_id, a.queue_name, arrival, coalesce(depth, 0) AS depth, coalesce(depth, 0) + arrival <= 1000 AS accepted
FROM (SELECT task_id, queue_name, row_number() OVER (PARTITION BY queue_name ORDER BY created_at, task_id) AS arrival
      FROM tasks WHERE created_at > {T}) a
LEFT JOIN (SELECT queue_name, count(*) AS depth FROM states WHERE state IN ('pending', 'delayed') GROUP BY queue_name) d
  ON a.queue_name = d.queue_name""",
)
# Row by row: each step of the recursion is the next event of every queue.
oracle(
    "admission_log",
    ["ev"],
    """
SELECT event_id, queue_name, kind, depth_before, depth, CASE WHEN kind = 'submitted' THEN depth_before < 40 END AS accepted FROM (
  WITH RECURSIVE moves AS (
    SELECT event_id, queue_name, kind, row_number() OVER (PARTITION BY queue_name ORDER BY ts, event_id) AS n
    FROM ev WHERE kind IN ('submitted', 'started')),
  replay AS (
    SELECT 0::BIGINT AS event_id, queue_name, '' AS kind, 0::BIGINT AS n, 0::BIGINT AS depth_before, 0::BIGINT AS depth FROM (SELECT DISTINCT queue_name FROM moves)
    UNION ALL
    SELECT m.event_id, m.queue_name, m.kind, m.n, r.depth,
           CASE WHEN m.kind = 'submitted' THEN least(40, r.depth + 1) ELSE greatest(0, r.depth - 1) END
    FROM replay r JOIN moves m ON m.queue_name = r.queue_name AND m.n = r.n + 1)
  SELECT * FROM replay WHERE n > 0) x""",
)
oracle(
    "next_k_tasks",
    ["ready"],
    f"SELECT task_id, queue_name, priority, created_at FROM ready ORDER BY {URGENCY} LIMIT 100",
)
oracle(
    "next_k_per_queue",
    ["ready"],
    f"""
SELECT * FROM (SELECT task_id, queue_name, priority, created_at,
       CAST(row_number() OVER (PARTITION BY queue_name ORDER BY {URGENCY}) AS INTEGER) AS position FROM ready) x
WHERE position <= 25""",
)
oracle(
    "delayed_due_order",
    ["delayed"],
    "SELECT task_id, queue_name, execute_after FROM delayed ORDER BY execute_after, task_id",
)
oracle(
    "dlq_listing",
    ["dead"],
    "SELECT task_id, queue_name, retry_count, last_error, dead_at FROM dead ORDER BY dead_at, task_id",
)
oracle(
    "backlog_union",
    ["existing"],
    f"""SELECT task_id, queue_name, CASE WHEN execute_after > {T} THEN 'delayed' ELSE 'pending' END AS origin, execute_after
FROM existing""",
)
oracle(
    "promote_delayed",
    ["existing"],
    f"""
SELECT task_id, queue_name, CASE WHEN execute_after > {T} THEN 'delayed' ELSE 'pending' END AS origin,
       CASE WHEN execute_after > TIMESTAMP '1998-06-22 00:00:00' THEN 'delayed'
            WHEN execute_after > {T} THEN 'promoted' ELSE 'pending' END AS destination
FROM existing""",
)
oracle(
    "requeue_expired",
    ["leases"],
    "SELECT task_id, queue_name, CASE WHEN expired THEN 'pending' ELSE 'processing' END AS state FROM leases",
)
oracle(
    "backoff_seconds",
    ["plan"],
    """SELECT failures AS retry_count, count(*) AS retries, power(2, failures) AS backoff_s
FROM plan WHERE disposition = 'retry' GROUP BY failures""",
)
oracle(
    "epoch_iso_convert",
    [],
    """
SELECT event_id, epoch_us(ts) / 1e6 AS epoch_s,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
       strftime(ts, '%H:%M:%S') AS clock
FROM events""",
)


def number_sql(x: str, decimals: int = 2) -> str:
    return f"""CASE WHEN {x} < 1000 THEN format('{{:.{decimals}f}}', {x})
         WHEN {x} < 1000000 THEN format('{{:.1f}}', {x} / 1000) || 'K' ELSE format('{{:.1f}}', {x} / 1000000) || 'M' END"""


def duration_sql(x: str) -> str:
    return f"""CASE WHEN {x} < 1 THEN format('{{:.0f}}', {x} * 1000) || 'ms' WHEN {x} < 60 THEN format('{{:.1f}}', {x}) || 's'
         WHEN {x} < 3600 THEN format('{{:.1f}}', {x} / 60) || 'm' ELSE format('{{:.1f}}', {x} / 3600) || 'h' END"""


oracle(
    "format_number",
    [],
    f"""
SELECT l_extendedprice AS price, {number_sql("l_extendedprice")} AS price_text,
       {number_sql("(l_extendedprice / 100)")} AS small_text, {number_sql("(l_extendedprice * 100)")} AS large_text,
       {number_sql("(l_discount + l_tax)", 1)} AS one_place
FROM lineitem""",
)
oracle(
    "format_duration",
    [],
    f"""
SELECT event_id, {duration_sql("value")} AS as_seconds, {duration_sql("(value / 1000)")} AS as_millis,
       {duration_sql("(value * 60)")} AS as_minutes
FROM events""",
)
oracle(
    "math_tasks",
    ["fields"],
    """
SELECT task_id,
       round(CASE op WHEN 'add' THEN a + b WHEN 'multiply' THEN a * b WHEN 'divide' THEN a / nullif(b, 0) END, 6) AS value,
       CASE WHEN op = 'divide' AND b = 0 THEN 'Division by zero'
            WHEN op NOT IN ('add', 'multiply', 'divide') THEN 'Unknown operation: ' || op END AS error
FROM fields""",
)
oracle("apply_handlers", ["handled"], "SELECT task_id, task_type, handler_kind, result, error FROM handled")
oracle(
    "error_side_output",
    ["handled"],
    """
SELECT task_id, task_type, CASE WHEN handler_kind = 'simple' THEN 'cannot handle power' ELSE error END AS error
FROM handled WHERE error IS NOT NULL OR (handler_kind = 'simple' AND op = 'power')""",
)
oracle(
    "error_callback",
    ["handled"],
    """
SELECT task_id, CASE WHEN handler_kind = 'simple' THEN 'ValueError in ' || task_type || ': cannot handle power'
                     ELSE 'HandlerError in ' || task_type || ': ' || error END AS noted
FROM handled WHERE error IS NOT NULL OR (handler_kind = 'simple' AND op = 'power')""",
)
oracle(
    "process_batch",
    ["handled"],
    f"""
SELECT task_id, queue_name, task_type,
       CASE WHEN error IS NULL THEN 'completed' WHEN 1 >= max_retries THEN 'dead' ELSE 'retry' END AS outcome,
       result, error, CASE WHEN error IS NULL THEN 0 ELSE 1 END AS retry_count,
       CASE WHEN error IS NOT NULL AND 1 < max_retries THEN {T} + to_seconds(2) END AS next_execute_after
FROM handled""",
)


# Streams over one table run to its end: windows and timers up to the watermark have closed.
# The watermark follows the rows that are left after a filter.
RETRY_KINDS = "kind IN ('submitted', 'completed', 'failed')"
LEASE_KINDS = "kind IN ('started', 'extended', 'completed', 'failed')"


def closed_sql(delay: str, rows: str = "true") -> str:
    return f"(SELECT max(ts) FROM ev WHERE {rows}) - INTERVAL {delay}"


oracle("task_stream_source", ["tasks"], f"SELECT {TASK} FROM tasks")
oracle(
    "stream_delayed_release",
    ["tasks"],
    """
SELECT task_id, queue_name, priority, coalesce(execute_after > created_at, false) AS held,
       greatest(created_at, coalesce(execute_after, created_at)) AS released_at
FROM tasks
WHERE execute_after IS NULL OR execute_after <= created_at
   OR execute_after <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 36 HOURS""",
)
PARTS["failures"] = (
    ["ev"],
    """
  SELECT task_id, ts, CAST((row_number() OVER (PARTITION BY task_id, segment ORDER BY ts, event_id) - 1) % 3 + 1 AS INTEGER) AS n
  FROM (SELECT *, count(*) FILTER (WHERE kind <> 'failed')
               OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment
        FROM ev WHERE kind IN ('submitted', 'completed', 'failed')) s
  WHERE kind = 'failed'""",
)
oracle(
    "stream_retry_dlq",
    ["failures"],
    f"""
SELECT task_id, 'dead' AS kind, n AS retry_count, ts AS at FROM failures WHERE n = 3
UNION ALL
SELECT task_id, 'retry', n, ts + to_seconds(CAST(power(2, n) AS BIGINT)) FROM failures WHERE n < 3
UNION ALL
SELECT task_id, 'requeued', n, ts + to_seconds(CAST(power(2, n) AS BIGINT)) FROM failures
WHERE n < 3 AND ts + to_seconds(CAST(power(2, n) AS BIGINT)) <= {closed_sql("10 MINUTES", RETRY_KINDS)}""",
)
PARTS["waits"] = (
    ["ev"],
    summary_sql(
        f"""(SELECT epoch_us(ts - submitted_at) / 1e6 AS wait_s, ts FROM
          (SELECT *, max(CASE WHEN kind = 'submitted' THEN ts END) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS submitted_at FROM ev) x
          WHERE kind = 'started' AND ts BETWEEN {E} - INTERVAL 1 DAY AND {E}) y""",
        "",
        "wait_s",
    ),
)


def numbers_sql(section: str, source: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{section}' AS section, '{name}' AS name, round(CAST({column} AS DOUBLE), 6) AS value FROM {source}" for name, column in columns.items()
    )


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


STATS = same("count", "avg", "min", "max", "p50", "p95", "p99")
oracle(
    "metrics_snapshot",
    ["page", "times", "waits", "failures", "depths"],
    "\nUNION ALL\n".join(
        [
            numbers_sql("", "page", same("uptime_seconds")),
            numbers_sql("counters", "page", same("tasks_submitted", "tasks_completed", "tasks_failed")),
            numbers_sql(
                "counters",
                f"(SELECT count(*) FILTER (WHERE n < 3) AS r, count(*) FILTER (WHERE n = 3) AS d FROM failures WHERE ts <= {E}) f",
                {"tasks_retried": "r", "tasks_dead_lettered": "d"},
            ),
            numbers_sql("gauges", "page", same("queue_depth", "active_workers", "active_tasks")),
            numbers_sql("rates", "page", same("submission_rate", "throughput_rate", "success_rate")),
            numbers_sql("processing_times", "times", STATS),
            numbers_sql("wait_times", "waits", STATS),
            numbers_sql("queue_depth_stats", "page", {"current": "queue_depth"}),
            numbers_sql(
                "queue_depth_stats",
                f"(SELECT avg(depth) AS a, min(depth) AS lo, max(depth) AS hi FROM depths WHERE ts BETWEEN {E} - INTERVAL 1 DAY AND {E}) q",
                {"avg": "a", "min": "lo", "max": "hi"},
            ),
            f"SELECT 'tasks_by_type', task_type, CAST(count(*) FILTER (WHERE kind = 'submitted') AS DOUBLE) FROM ev WHERE ts <= {E} GROUP BY task_type",
            f"SELECT 'failures_by_type', task_type, CAST(count(*) FILTER (WHERE kind = 'failed') AS DOUBLE) FROM ev WHERE ts <= {E} GROUP BY task_type",
            f"""SELECT 'recent_errors', error, value FROM (SELECT 'failed on ' || worker_id AS error, CAST(event_id AS DOUBLE) AS value
            FROM ev WHERE kind = 'failed' AND ts <= {E} ORDER BY ts DESC, event_id DESC LIMIT 10) e""",
        ]
    ),
)
oracle("stream_dead_letters", ["failures"], "SELECT task_id, n AS retry_count, ts AS at FROM failures WHERE n = 3")
# A start is decided once both streams' watermarks have passed its horizon.
oracle(
    "stream_attempt_pairs",
    ["ev"],
    """
SELECT task_id, event_id, queue_name, worker_id, ts AS started_at,
       CASE WHEN paired THEN next_ts END AS finished_at, CASE WHEN paired THEN next_kind END AS outcome,
       CASE WHEN paired THEN round(epoch_us(next_ts) / 1e6 - epoch_us(ts) / 1e6, 6) END AS processing_s
FROM (SELECT *, next_ts <= ts + INTERVAL 2 DAYS AND next_kind <> 'started' AS paired
      FROM (SELECT *, lead(ts) OVER w AS next_ts, lead(kind) OVER w AS next_kind
            FROM ev WHERE kind IN ('started', 'completed', 'failed') WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)) x
      WHERE kind = 'started') y
WHERE ts + INTERVAL 2 DAYS < (SELECT max(ts) - INTERVAL 1 HOUR FROM ev WHERE kind = 'started')""",
)
oracle(
    "stream_latest_submission",
    ["ev"],
    """
SELECT task_id, event_id, queue_name, priority, ts AS submitted_at, CAST(versions AS INTEGER) AS versions
FROM (SELECT *, count(*) OVER (PARTITION BY task_id, chain) AS versions
      FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 3 DAYS THEN 1 ELSE 0 END) OVER w AS chain
            FROM (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM ev WHERE kind = 'submitted'
                  WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)) x
            WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)) y) z
WHERE after > ts + INTERVAL 3 DAYS
   OR (after IS NULL AND ts + INTERVAL 3 DAYS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev WHERE kind = 'submitted'))""",
)
lease_parts("end_", f"({closed_sql('10 MINUTES', LEASE_KINDS)})", "true")
oracle(
    "stream_lease_timeout",
    ["end_sessions"],
    "SELECT task_id, worker_id, lease_time, expired_at FROM end_sessions WHERE expired_at IS NOT NULL",
)
oracle(
    "recovery_callback",
    ["end_sessions"],
    "SELECT task_id, worker_id, expired_at, 'pending' AS state FROM end_sessions WHERE expired_at IS NOT NULL",
)
oracle(
    "stream_rolling_metrics",
    ["ev"],
    f"""
SELECT window_start, window_start + INTERVAL 5 MINUTES AS window_end, task_type, count(*) AS events,
       count(*) FILTER (WHERE processing_s > 0) AS samples,
       round(sum(processing_s) FILTER (WHERE processing_s > 0), 6) AS total,
       round(min(processing_s) FILTER (WHERE processing_s > 0), 6) AS low,
       round(max(processing_s) FILTER (WHERE processing_s > 0), 6) AS high
FROM (SELECT *, unnest([date_trunc('minute', ts) - INTERVAL 0 MINUTES, date_trunc('minute', ts) - INTERVAL 1 MINUTES,
                        date_trunc('minute', ts) - INTERVAL 2 MINUTES, date_trunc('minute', ts) - INTERVAL 3 MINUTES,
                        date_trunc('minute', ts) - INTERVAL 4 MINUTES]) AS window_start FROM ev) x
WHERE window_start + INTERVAL 5 MINUTES <= {closed_sql("10 MINUTES")}
GROUP BY window_start, task_type""",
)
oracle(
    "stream_late_drop",
    ["ev"],
    f"""
SELECT date_trunc('hour', ts) AS window_start, task_type, count(*) AS events FROM ev
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {closed_sql("1 HOUR")} GROUP BY ALL""",
)
oracle("stream_dedup", ["ev"], "SELECT DISTINCT task_id, queue_name FROM ev WHERE kind = 'submitted'")
oracle(
    "stream_priority_batch",
    ["tasks"],
    f"""
SELECT task_id, queue_name, priority, CASE WHEN rn <= 1000 THEN 'taken' ELSE 'backlog' END AS disposition
FROM (SELECT *, row_number() OVER (ORDER BY {URGENCY}) AS rn FROM tasks) x""",
)
oracle("stream_at_least_once_sink", ["tasks"], "SELECT task_id, queue_name, created_at FROM tasks")
oracle(
    "stream_health",
    ["ev"],
    f"""
SELECT window_start, queue_name, queue_depth, round(success_rate, 6) AS success_rate,
       CASE WHEN queue_depth > 1000 OR success_rate < 95 OR (started = 0 AND queue_depth > 0)
            THEN 'unhealthy' ELSE 'healthy' END AS status,
       CASE WHEN p95 IS NULL OR p95 < 10 THEN 'ok' ELSE 'warning' END AS check_processing_time,
       concat_ws('; ', CASE WHEN queue_depth > 1000 THEN 'High queue depth' END,
         CASE WHEN success_rate < 95 THEN 'Low success rate' END,
         CASE WHEN started = 0 AND queue_depth > 0 THEN 'No active workers with pending tasks' END,
         CASE WHEN p95 > 10 THEN 'High p95 processing time' END) AS alerts
FROM (SELECT window_start, queue_name,
             greatest(0, count(*) FILTER (WHERE kind = 'submitted') - count(*) FILTER (WHERE kind IN ('completed', 'failed'))) AS queue_depth,
             coalesce(100.0::DOUBLE * count(*) FILTER (WHERE kind = 'completed')
                      / nullif(count(*) FILTER (WHERE kind IN ('completed', 'failed')), 0), 100.0::DOUBLE) AS success_rate,
             count(*) FILTER (WHERE kind = 'started') AS started,
             max(processing_s) FILTER (WHERE good AND rn = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1) AS p95
      FROM (SELECT *, date_trunc('hour', ts) AS window_start, kind = 'completed' AND processing_s > 0 AS good,
                   row_number() OVER (PARTITION BY date_trunc('hour', ts), queue_name, kind = 'completed' AND processing_s > 0
                                      ORDER BY processing_s) AS rn,
                   count(*) OVER (PARTITION BY date_trunc('hour', ts), queue_name, kind = 'completed' AND processing_s > 0) AS n
            FROM ev) e
      WHERE window_start + INTERVAL 1 HOUR <= {closed_sql("10 MINUTES")}
      GROUP BY window_start, queue_name) h""",
)

oracle(
    "task_defaults",
    [],
    """
SELECT CAST(o_orderkey AS VARCHAR) AS given_id, CASE WHEN o_orderkey % 3 = 0 THEN 'uuid' ELSE 'given' END AS id_source,
       CAST(1 AS BIGINT) AS id_rows, 0 AS retry_count, CAST(o_orderkey % 5 AS INTEGER) AS max_retries, 'pending' AS status
FROM orders""",
)
