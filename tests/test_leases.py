"""Lease boundaries, ownership and the session fold against a replay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taskloom.operators import leases, lifecycle

BASE = "2024-01-01 00:00:00"


def at(seconds):
    return F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def clock(seconds: int) -> str:
    return f"2024-01-01 {seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}"


def lease_table(spark, rows):
    df = spark.createDataFrame(rows, "task_id STRING, worker_id STRING, s INT, timeout_s DOUBLE")
    return df.withColumn("lease_time", at(F.col("s"))).drop("s")


def test_expiry_is_strict_and_zero_means_default(spark):
    table = lease_table(spark, [("a", "w", 0, 100.0), ("b", "w", 0, 0.0), ("c", "w", 0, None), ("d", "w", 50, 100.0)])
    assert {r.task_id for r in leases.lease_expired_filter(table, clock(100)).collect()} == set()
    assert {r.task_id for r in leases.lease_expired_filter(table, clock(101)).collect()} == {"a"}
    assert {r.task_id for r in leases.lease_expired_filter(table, clock(301)).collect()} == {"a", "b", "c", "d"}
    left = {r.task_id: r.remaining_s for r in leases.with_expiry(table, clock(120)).collect()}
    assert left == {"a": 0.0, "b": 180.0, "c": 180.0, "d": 30.0}


def test_near_expiry_is_above_four_fifths(spark):
    table = lease_table(spark, [("a", "w", 0, 100.0)])
    assert leases.lease_near_expiry(table, clock(80)).count() == 0
    assert leases.lease_near_expiry(table, clock(81)).count() == 1


def test_stats_without_leases_are_zero(spark):
    row = leases.lease_stats(lease_table(spark, []), clock(10)).first()
    assert tuple(row) == (0, 0, 0.0, 0.0)
    row = leases.lease_stats(lease_table(spark, [("a", "w", 0, 10.0), ("b", "w", 90, 60.0), ("c", "w", 70, 60.0)]), clock(100)).first()
    assert tuple(row) == (3, 1, 20.0, 30.0)


def test_owner_checks_and_conflicts(spark):
    table = lease_table(spark, [("a", "w1", 0, 100.0)])
    asks = spark.createDataFrame([("a", "w1", 50), ("a", "w2", 50), ("b", "w1", 50), ("a", "w2", 101), ("a", "w2", 100)], "task_id STRING, worker_id STRING, s INT")
    asks = asks.withColumn("ts", at(F.col("s")))
    checked = leases.lease_action_check(asks, table)
    assert [r.outcome for r in checked.orderBy("task_id", "worker_id", "s").collect()] == ["ok"] + ["wrong_worker"] * 3 + ["not_found"]
    found = leases.lease_conflicts(asks.filter("worker_id = 'w2' or task_id = 'b'"), table)
    assert [r.outcome for r in found.orderBy("task_id", "s").collect()] == ["conflict", "conflict", "override_expired", "acquired"]


def test_expired_leases_go_back_and_hide_nothing(spark):
    table = lease_table(spark, [("a", "w", 0, 10.0), ("b", "w", 0, 1000.0)])
    moved = leases.requeue_expired(table, clock(100))
    assert {r.task_id: r.state for r in moved.collect()} == {"a": "pending", "b": "processing"}
    ready = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id STRING")
    assert {r.task_id for r in leases.visible_tasks(ready, table, clock(100)).collect()} == {"a", "c"}


def test_stale_rows_by_chosen_age(spark):
    df = spark.createDataFrame([("a", "processing", 0, 250), ("b", "pending", 0, 0)], "task_id STRING, state STRING, s INT, t INT")
    df = df.withColumns({"created_at": at(F.col("s")), "started_at": at(F.col("t"))})
    assert leases.stale_filter(df, clock(300)).count() == 0
    assert [r.state for r in leases.stale_filter(df, clock(301)).collect()] == ["pending"]
    assert leases.stale_filter(df, clock(301), age_from="started_at").count() == 0


def random_log(seed, n=300):
    rng = random.Random(seed)
    rows, s = [], 0
    for i in range(n):
        s += rng.randrange(1, 60)
        rows.append((i, rng.choice("aab"), rng.choice(["started", "extended", "extended", "completed", "failed"]), rng.choice(["w1", "w2"]), s, rng.choice([30, 100, 400])))
    return rows


def replay(rows, now, extension=300):
    out = []
    for task in {r[1] for r in rows}:
        lease, n = None, 0
        for _, t, kind, worker, s, timeout in rows:
            if t != task or s > now:
                continue
            if lease and lease["expired"] is None and s > lease["deadline"]:
                lease["expired"] = lease["deadline"]
            if kind == "started":
                if lease:
                    lease["ended"] = lease["ended"] or s
                    out.append(lease)
                n += 1
                lease = dict(task=task, no=n, worker=worker, at=s, deadline=s + timeout, ended=None, expired=None)
            elif lease and lease["ended"] is None:
                if kind != "extended":
                    lease["ended"] = s
                elif worker == lease["worker"] and lease["expired"] is None:
                    lease["deadline"] += extension
        if lease:
            if lease["ended"] is None and lease["expired"] is None and now > lease["deadline"]:
                lease["expired"] = lease["deadline"]
            out.append(lease)
    for lease in out:
        if lease["ended"] is not None and lease["expired"] is not None and lease["expired"] >= lease["ended"]:
            lease["expired"] = None
    return {(r["task"], r["no"]): (r["worker"], r["deadline"], r["ended"], r["expired"]) for r in out}


@pytest.mark.parametrize("chunk_s", [604800, 15])
@pytest.mark.parametrize("seed", [3, 4])
def test_sessions_against_replay(spark, seed, chunk_s):
    rows = random_log(seed)
    now = rows[-1][4] + 50
    df = spark.createDataFrame(rows, "event_id INT, task_id STRING, kind STRING, worker_id STRING, s INT, timeout_s INT")
    df = df.withColumn("ts", at(F.col("s")))
    out = leases.lease_sessions(df, clock(now), chunk_s=chunk_s)

    def secs(name):
        return (F.unix_micros(F.col(name).cast("timestamp")) - F.unix_micros(F.lit(BASE).cast("timestamp"))) / 1e6

    found = {
        (r.task_id, r.lease_no): (r.worker_id, r.d, r.e, r.x)
        for r in out.select("*", secs("deadline").alias("d"), secs("ended_at").alias("e"), secs("expired_at").alias("x")).collect()
    }
    assert found == replay(rows, now)
    counted = leases.lease_counters(out).first()
    assert counted.lease_expirations_total == sum(v[3] is not None for v in found.values())


def test_audit_verdicts(spark):
    moves = ["submitted", "started", "completed", "completed", "failed", "extended", "started", "started", "submitted", "completed"]
    df = spark.createDataFrame([(i, "t", k, i) for i, k in enumerate(moves)], "event_id INT, task_id STRING, kind STRING, s INT")
    out = lifecycle.transition_audit(df.withColumn("ts", at(F.col("s")))).orderBy("event_id").collect()
    assert [r.verdict for r in out] == [
        "ok", "ok", "ok", "completed_twice", "failed_after_completed", "extended_without_lease", "ok", "started_twice",
        "submitted_while_open", "finished_without_start",
    ]


def test_completions_and_attempt_pairs(spark):
    processing = spark.createDataFrame([("a",), ("b",)], "task_id STRING")
    done = spark.createDataFrame([("a",), ("a",), ("z",)], "task_id STRING")
    split = lifecycle.apply_completions(processing, done)
    assert {r.task_id: r.disposition for r in split.collect()} == {"a": "completed", "b": "processing"}
    log = [("started", 0), ("completed", 7), ("started", 10), ("started", 20), ("failed", 23)]
    df = spark.createDataFrame([(i, "t", "q", "w", k, s) for i, (k, s) in enumerate(log)], "event_id INT, task_id STRING, queue_name STRING, worker_id STRING, kind STRING, s INT")
    pairs = lifecycle.event_attempts(df.withColumn("ts", at(F.col("s")))).orderBy("attempt_no").collect()
    assert [(r.outcome, r.processing_s) for r in pairs] == [("completed", 7.0), (None, None), ("failed", 3.0)]
