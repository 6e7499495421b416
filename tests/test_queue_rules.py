"""Readiness, order, capacity, retries and dead letters at their boundaries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from taskloom.operators import dispatch, lifecycle, metrics, rates

TASK = (
    "task_id STRING, queue_name STRING, priority INT, created_at TIMESTAMP_NTZ, execute_after TIMESTAMP_NTZ, "
    "max_retries INT"
)
NOW = "2024-01-01 12:00:00"


def tasks(spark, rows):
    """Rows of (id, priority, due or None, max_retries)."""
    text = spark.createDataFrame(
        [(i, "q", p, "2024-01-01 00:00:00", due, m) for i, p, due, m in rows],
        TASK.replace("TIMESTAMP_NTZ", "STRING"),
    )
    return text.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "execute_after")})


def attempts(spark, rows):
    """Rows of (task, number, outcome); attempt n starts at minute n and takes a second."""
    df = spark.createDataFrame(rows, "task_id STRING, attempt_no LONG, outcome STRING")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return df.select(
        "*",
        (start + F.make_dt_interval(mins=F.col("attempt_no").cast("int"))).alias("started_at"),
        (start + F.make_dt_interval(mins=F.col("attempt_no").cast("int"), secs=F.lit(1))).alias("finished_at"),
        F.lit(1.0).alias("processing_s"),
        F.lit("w1").alias("worker_id"),
        F.when(F.col("outcome") == "failed", F.concat(F.lit("E"), "attempt_no")).alias("error"),
    )


def test_priority_order(spark):
    df = tasks(spark, [("t1", 2, None, 3), ("t2", 1, None, 3), ("t3", 3, None, 3)])
    ready = dispatch.ready_filter(df, NOW)
    assert [r.task_id for r in dispatch.next_k(ready, 3).collect()] == ["t2", "t1", "t3"]
    positions = {r.task_id: r.position for r in dispatch.dispatch_order(ready).collect()}
    assert positions == {"t2": 1, "t1": 2, "t3": 3}
    assert [r.task_id for r in dispatch.next_k_per_queue(ready, 1, ["queue_name"]).collect()] == ["t2"]


def test_delayed_task_does_not_block_ready_ones(spark):
    df = tasks(spark, [("now", 5, None, 3), ("later", 1, "2024-01-01 12:00:01", 3)])
    assert [r.task_id for r in dispatch.ready_filter(df, NOW).collect()] == ["now"]
    later = dispatch.ready_filter(df, "2024-01-01 12:00:01")  # due exactly now is ready
    assert [r.task_id for r in dispatch.next_k(later, 1).collect()] == ["later"]


def test_promotion_loses_nothing(spark):
    df = tasks(spark, [("a", 1, None, 3), ("b", 1, "2024-01-01 13:00:00", 3), ("c", 1, "2024-01-02 00:00:00", 3)])
    moved = dispatch.promote_delayed(dispatch.backlog_union(df, NOW), "2024-01-01 13:00:00")
    assert {r.task_id: r.destination for r in moved.collect()} == {"a": "pending", "b": "promoted", "c": "delayed"}


def test_capacity(spark):
    df = tasks(spark, [("t1", 1, None, 3), ("t2", 2, None, 3), ("t3", 3, None, 3)])
    empty = spark.createDataFrame([], "queue_name STRING, queue_size LONG")
    taken = dispatch.capacity_admission(df, empty, max_size=2)
    assert {r.task_id: r.accepted for r in taken.collect()} == {"t1": True, "t2": True, "t3": False}
    half = spark.createDataFrame([("q", 1)], "queue_name STRING, queue_size LONG")
    taken = dispatch.capacity_admission(df, half, max_size=2)
    assert sum(r.accepted for r in taken.collect()) == 1


@pytest.mark.parametrize("limit,dispositions", [
    (0, ["dead", "ignored", "ignored"]),
    (1, ["dead", "ignored", "ignored"]),
    (2, ["retry", "dead", "ignored"]),
    (3, ["retry", "retry", "dead"]),
    (4, ["retry", "retry", "retry"]),
])
@pytest.mark.parametrize("chunk", [4096, 1])
def test_failures_until_dead(spark, limit, dispositions, chunk):
    log = attempts(spark, [("a", n, "failed") for n in (1, 2, 3)])
    plan = lifecycle.retry_plan(log, tasks(spark, [("a", 1, None, limit)]), chunk=chunk)
    rows = plan.orderBy("attempt_no").collect()
    assert [r.disposition for r in rows] == dispositions
    assert [r.backoff_s for r in rows if r.disposition == "retry"] == [2.0, 4.0, 8.0][: dispositions.count("retry")]


def test_attempts_after_completion_are_ignored(spark):
    log = attempts(spark, [("a", 1, "failed"), ("a", 2, "completed"), ("a", 3, "completed"), ("a", 4, "failed")])
    plan = lifecycle.retry_plan(log, tasks(spark, [("a", 1, None, 2)]))
    assert [r.disposition for r in plan.orderBy("attempt_no").collect()] == ["retry", "completed", "ignored", "ignored"]


def test_states_add_up(spark):
    df = tasks(spark, [
        ("new", 1, None, 3), ("later", 1, "2024-01-02 00:00:00", 3), ("done", 1, None, 3), ("gone", 1, None, 1),
        ("again", 1, None, 3), ("busy", 1, None, 3),
    ])
    log = attempts(spark, [("done", 1, "completed"), ("gone", 1, "failed"), ("again", 1, "failed"), ("busy", 720, "completed")])
    states = lifecycle.task_states(df, log, NOW)
    assert {r.task_id: r.state for r in states.collect()} == {
        "new": "pending", "later": "delayed", "done": "completed", "gone": "dead", "again": "pending", "busy": "processing",
    }
    row = metrics.queue_stats(states).first()
    assert row.total_tasks == row.pending + row.processing + row.delayed + row.dead_letters + 1
    counters = metrics.lifecycle_counters(states, ["queue_name"]).first()
    assert (counters.submitted, counters.started, counters.completed, counters.failed) == (6, 4, 1, 2)
    assert (counters.retried, counters.dead_lettered, counters.backlog) == (1, 1, 3)
    assert dispatch.purge_report(states).first().asDict() == {
        "queue_name": "q", "tasks_cleared": 3, "dead_letters_cleared": 1,
    }
    assert dispatch.purge(states, ["q"]).count() == 0


def test_retention(spark):
    df = tasks(spark, [("old", 1, None, 3), ("fresh", 1, None, 3), ("open", 1, None, 3)])
    log = attempts(spark, [("old", 1, "completed"), ("fresh", 700, "completed")])
    kept = lifecycle.completed_retention(lifecycle.task_states(df, log, NOW), NOW, 3600)
    assert {r.task_id for r in kept.collect()} == {"fresh", "open"}


def test_dlq_page_bounds(spark):
    dead = spark.createDataFrame([(str(i), i) for i in range(10)], "task_id STRING, dead_at INT")
    assert [r.task_id for r in dispatch.dlq_page(dead, 3, 2).collect()] == ["2", "3", "4"]
    assert [r.task_id for r in dispatch.dlq_page(dead, 2, 0, newest_first=True).collect()] == ["9", "8"]
    for limit, offset in ((0, 0), (1001, 0), (1, -1)):
        with pytest.raises(ValueError):
            dispatch.dlq_page(dead, limit, offset)


def test_lookup_prefers_the_live_store(spark):
    def ids(*names):
        return spark.createDataFrame([(n,) for n in names], "task_id STRING")
    live = ids("a", "b").withColumn("state", F.lit("pending"))
    dead = ids("b", "c").withColumn("state", F.lit("dead"))
    found = dispatch.lookup_with_dlq_fallback(ids("a", "b", "c", "d"), live, dead)
    assert {r.task_id: (r.source, r.state) for r in found.collect()} == {
        "a": ("live", "pending"), "b": ("live", "pending"), "c": ("dlq", "dead"), "d": ("not_found", None),
    }


@pytest.mark.parametrize("chunk_s", [86400, 1])
def test_paced_releases(spark, chunk_s):
    starts = [0.0, 0.05, 0.1, 2.0, 2.0, 2.1, 2.5, 9.0]
    df = spark.createDataFrame([(str(i), "q", 1, s) for i, s in enumerate(starts)], "task_id STRING, queue_name STRING, priority INT, s DOUBLE")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = df.withColumn("ready_at", base + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")))
    out = rates.rate_limited_schedule(df, "2024-01-01 00:00:00", rate=3, chunk_s=chunk_s)
    got = [r.release_at.timestamp() for r in out.orderBy("release_no").collect()]
    due, expected = None, []
    for s in starts:
        due = s if due is None else max(s, due + 1 / 3)
        expected.append(due)
    assert [g - got[0] for g in got] == pytest.approx(expected, abs=2e-6)
    assert all(b - a >= 1 / 3 - 2e-6 for a, b in zip(got, got[1:]))


def test_rate_audit_first_start_is_free(spark):
    df = spark.createDataFrame([(1, "q", 0), (2, "q", 1), (3, "q", 3)], "event_id INT, queue_name STRING, s INT")
    df = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")))
    out = rates.rate_limit_audit(df, rate=0.5).orderBy("event_id").collect()
    assert [(r.gap_s, r.too_early) for r in out] == [(None, False), (1.0, True), (2.0, False)]
