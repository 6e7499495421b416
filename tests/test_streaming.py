"""Streams over several files: equal to the batch result, restartable, without double effects."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from taskloom.operators import leases, lifecycle
from taskloom.sources import views
from taskloom.streaming import intake, pairing, sinks, stateful, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def event_log(spark):
    """Events with zoned time and a far-away last row that lets all windows and timers close."""
    events = views.table(spark, SF, "events")
    last = spark.createDataFrame([(10**9, 10**9, "view", 1.0, '{"k": 1}')], "event_id LONG, user_id LONG, event_type STRING, value DOUBLE, props STRING")
    last = last.withColumn("ts", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    return events.unionByName(last.select(events.columns))


def staged(spark, df, folder, parts=4, order="ts"):
    """One file per part, in order of time."""
    ordered = df.orderBy(order).collect()
    size = -(-len(ordered) // parts)
    for n in range(parts):
        spark.createDataFrame(ordered[n * size : (n + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def streamed(spark, folder, schema, max_files=1):
    stream = views.event_columns(intake.stream_folder(spark, folder, schema, max_files))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(str, df.select(columns).collect()))


@pytest.fixture(scope="module")
def folder(spark, event_log, tmp_path_factory):
    return staged(spark, event_log, str(tmp_path_factory.mktemp("events") / "in"))


def test_leases_over_many_steps_equal_the_batch(spark, event_log, folder):
    stream = stateful.lease_timeout(streamed(spark, folder, event_log.schema))
    out = intake.run_and_read(spark, stream, "lease-test")
    whole = leases.lease_sessions(views.event_columns(event_log), "2024-12-31 00:00:00").filter("expired_at is not null")
    assert rows(out) == rows(whole.select("task_id", "worker_id", "lease_time", "expired_at"))


def test_retries_over_many_steps_equal_one_step(spark, event_log, folder):
    by_file = intake.run_and_read(spark, stateful.retry_dlq(streamed(spark, folder, event_log.schema)), "retry-a")
    at_once = intake.run_and_read(spark, stateful.retry_dlq(streamed(spark, folder, event_log.schema, 100)), "retry-b")
    # The last rows' back-offs are still open, as the far-away row is no failure and does not move this watermark.
    decided = F.col("kind") != "requeued"
    assert rows(by_file.filter(decided)) == rows(at_once.filter(decided))
    assert by_file.filter("kind = 'requeued'").count() <= by_file.filter("kind = 'retry'").count()


def test_rolling_windows_equal_the_batch(spark, event_log, folder):
    out = intake.run_and_read(spark, windows.rolling_metrics(streamed(spark, folder, event_log.schema)), "rolling-test")
    batch = views.event_columns(event_log.filter("event_id < 1000000")).withColumn("ts", F.col("ts").cast("timestamp"))
    whole = windows.rolling_metrics(batch)
    assert rows(out.select("start", "task_type", "events", "samples", "low", "high")) == rows(
        whole.select("start", "task_type", "events", "samples", "low", "high")
    )


def test_late_rows_are_dropped_and_counted(spark, event_log, folder, tmp_path):
    events = event_log.filter("event_id < 1000000")
    path = staged(spark, events, str(tmp_path / "in"), parts=2)
    events.orderBy("ts").limit(20).coalesce(1).write.mode("append").parquet(path)
    counted = windows.rolling_metrics(streamed(spark, path, events.schema), "1 hour", "1 hour", "1 hour")
    query = intake.run_to_table(counted, str(tmp_path / "out"), str(tmp_path / "cp"))
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped > 0
    seen = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("events")).first()[0]
    assert 0 < seen <= events.count()


def test_restart_takes_new_files_only(spark, event_log, tmp_path):
    events = event_log.filter("event_id < 1000000").orderBy("ts")
    first, second = events.limit(400), events.offset(400)
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(path)
        intake.run_to_table(streamed(spark, path, events.schema), out, cp, ["queue_name"])
    assert spark.read.parquet(out).count() == events.count()
    intake.run_to_table(streamed(spark, path, events.schema), out, cp, ["queue_name"])
    assert spark.read.parquet(out).count() == events.count()


def test_repeated_batch_has_no_second_effect(spark, tmp_path):
    step = sinks.idempotent_sink(str(tmp_path))
    batch = spark.range(10)
    step(batch, 0)
    step(batch, 0)
    step(spark.range(5), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 15


def test_priority_batches_take_from_the_backlog(spark, tmp_path):
    schema = "task_id STRING, priority INT, created_at TIMESTAMP_NTZ"
    def batch(*pairs):
        df = spark.createDataFrame(list(pairs), "task_id STRING, priority INT")
        return df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    step = sinks.priority_sink(str(tmp_path), 2, schema)
    for _ in range(2):  # a repeated batch gives the same result
        step(batch(("a", 5), ("b", 1), ("c", 3)), 0)
    step(batch(("d", 2), ("e", 9)), 1)
    def ids(rows):
        return sorted(r.task_id for r in rows.collect())
    taken = sinks.Backlog(spark, str(tmp_path), schema).taken
    assert ids(spark.read.parquet(str(tmp_path / "taken/step=0"))) == ["b", "c"] and ids(taken()) == ["a", "b", "c", "d"]
    assert ids(sinks.Backlog(spark, str(tmp_path), schema).waiting(2)) == ["e"]


def test_backlog_is_a_log(spark, tmp_path):
    """Against a list: steps write arrivals and takes only, compaction changes no result, a repeated step writes the same."""
    schema = "task_id STRING, priority INT, created_at TIMESTAMP_NTZ"
    rng, path, waiting = random.Random(6), str(tmp_path), []
    backlog = sinks.Backlog(spark, path, schema, compact_every=2)
    for step, k in enumerate([3, 0, 4, 2, 5, 40]):
        new = [(f"{step}-{i}", rng.randrange(4)) for i in range(rng.choice([0, 6, 9]))]
        df = spark.createDataFrame(new, "task_id STRING, priority INT").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
        for _ in range(2):
            backlog.advance(df, step, k)
        waiting = sorted(waiting + new, key=lambda t: (t[1], t[0]))
        chosen, waiting = waiting[:k], waiting[k:]
        assert sorted(r.task_id for r in backlog._read("taken", range(step, step + 1)).collect()) == sorted(t for t, _ in chosen)
        assert sorted(r.task_id for r in backlog.waiting(step + 1).collect()) == sorted(t for t, _ in waiting)
        assert backlog._read("arrived", range(step, step + 1)).count() == len(new)
    assert waiting == [] and backlog.taken().count() == backlog.taken().select("task_id").distinct().count()


def test_a_broken_dead_letter_step_has_one_effect(spark, tmp_path, monkeypatch):
    """A step dies between its rows and its manifest row and is run again; a finished step is repeated."""
    path, schema = str(tmp_path / "table"), "id LONG"
    step, commit = sinks.dead_letter_sink(path), sinks.ManifestTable.commit
    assert sinks.ManifestTable(spark, path).read(schema).count() == 0
    step(spark.range(5), 0)

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(sinks.ManifestTable, "commit", dies)
    with pytest.raises(RuntimeError):
        step(spark.range(5, 9), 1)
    assert sinks.ManifestTable(spark, path).read(schema).count() == 5
    monkeypatch.setattr(sinks.ManifestTable, "commit", commit)
    for n, rows in ((1, spark.range(5, 9)), (1, spark.range(5, 9)), (0, spark.range(5)), (2, spark.range(0))):
        step(rows, n)
    assert sorted(r.id for r in sinks.ManifestTable(spark, path).read(schema).collect()) == list(range(9))


def test_a_stream_killed_in_its_sink_goes_on(spark, event_log, folder, tmp_path, monkeypatch):
    """The query fails in its second step, after the rows are written; a restart from the checkpoint loses and repeats nothing."""
    dead = lambda: stateful.retry_dlq(streamed(spark, folder, event_log.schema)).filter("kind = 'dead'")
    whole = intake.run_and_read(spark, dead(), "dead-whole")
    path, commit, calls = str(tmp_path / "table"), sinks.ManifestTable.commit, []

    def dies_once(self, batch_id, name):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("killed")
        commit(self, batch_id, name)

    monkeypatch.setattr(sinks.ManifestTable, "commit", dies_once)
    with pytest.raises(Exception, match="killed"):
        intake.run_each_batch(dead(), sinks.dead_letter_sink(path), str(tmp_path / "cp"))
    intake.run_each_batch(dead(), sinks.dead_letter_sink(path), str(tmp_path / "cp"))
    assert calls[1] == calls[2]
    assert rows(sinks.ManifestTable(spark, path).read(whole.schema)) == rows(whole) != []


def test_attempt_pairs_over_many_steps_equal_the_batch(spark, event_log, folder):
    stream = lambda: streamed(spark, folder, event_log.schema)
    # The far-away row is a view, so one start of its kind closes the other side's horizon.
    pairs = intake.run_and_read(spark, pairing.attempt_pairs(stream(), stream(), "2 days"), "pairs-test")
    batch = lifecycle.event_attempts(views.event_columns(event_log.filter("event_id < 1000000")))
    horizon = F.col("started_at") + F.expr("INTERVAL 2 DAYS")
    within = F.col("finished_at") <= horizon
    batch = batch.select("task_id", "started_at", F.when(within, F.col("finished_at")).alias("finished_at"), F.when(within, F.col("outcome")).alias("outcome"))
    starts = views.event_columns(event_log).filter("kind = 'started'").agg(F.max("ts")).first()[0]
    closed = batch.filter(horizon < F.lit(starts) - F.expr("INTERVAL 1 HOUR"))
    found = pairs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "finished_at")})
    assert rows(found.select(closed.columns)) == rows(closed)
    outcomes = {r.outcome for r in found.select("outcome").distinct().collect()}
    assert outcomes == {"completed", "failed", None}


def test_latest_submission_inside_and_beyond_the_horizon(spark, tmp_path):
    day = "2024-01-0"
    files = [
        [("a", 1, "1 00:00:00"), ("b", 2, "1 00:00:00"), ("b", 3, "1 06:00:00"), ("c", 4, "1 00:00:00"), ("c", 5, "2 00:00:00")],
        [("a", 6, "1 12:00:00"), ("b", 7, "3 00:00:00")],
        [("a", 8, "2 12:00:01"), ("z", 9, "9 00:00:00")],
    ]
    for rows_ in files:
        df = spark.createDataFrame([(t, i, "submitted", f"q{i}", i, day + s) for t, i, s in rows_], "task_id STRING, event_id LONG, kind STRING, queue_name STRING, priority INT, ts STRING")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = intake.stream_folder(spark, str(tmp_path / "in"), schema, 1)
    out = intake.run_and_read(spark, stateful.latest_submission(stream, 86400, "3 days"), "latest-test").collect()
    # a: a repeat within a day of the first replaces it, the third came a second too late; c: exactly a day is within; z is still open.
    assert sorted((r.task_id, r.event_id, r.queue_name, r.priority, r.versions) for r in out) == [
        ("a", 6, "q6", 6, 2), ("a", 8, "q8", 8, 1), ("b", 3, "q3", 3, 2), ("b", 7, "q7", 7, 1), ("c", 5, "q5", 5, 2),
    ]


def test_delayed_tasks_wait_and_can_be_replaced(spark, tmp_path):
    def file(*tuples):
        df = spark.createDataFrame(list(tuples), "task_id STRING, queue_name STRING, priority INT, created_at STRING, execute_after STRING")
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "execute_after")})
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema
    day = "2024-01-01 "
    file(("now", "q", 1, day + "00:00:00", None), ("due", "q", 1, day + "00:00:00", day + "00:00:00"), ("a", "q", 1, day + "00:00:00", day + "05:00:00"), ("b", "q", 1, day + "00:00:00", day + "06:00:00"))
    file(("b", "q", 2, day + "01:00:00", day + "03:00:00"), ("tick", "q", 1, day + "04:30:00", None))
    schema = file(("end", "q", 1, "2024-02-01 00:00:00", None), ("open", "q", 1, "2024-02-01 00:00:00", "2024-03-01 00:00:00"))
    stream = stateful.delayed_release(intake.stream_folder(spark, str(tmp_path / "in"), schema, 1))
    out = {r.task_id: (str(r.released_at), r.held, r.priority) for r in intake.run_and_read(spark, stream, "held").collect()}
    assert out == {
        "now": (day + "00:00:00", False, 1), "due": (day + "00:00:00", False, 1), "a": (day + "05:00:00", True, 1),
        "b": (day + "03:00:00", True, 2), "tick": (day + "04:30:00", False, 1), "end": ("2024-02-01 00:00:00", False, 1),
    }


@pytest.mark.parametrize("buckets", [1, 16])
def test_delayed_tasks_share_the_state_of_a_bucket(spark, tmp_path, buckets):
    schema = "task_id STRING, queue_name STRING, priority INT, at BIGINT, due BIGINT"
    hour = 3600
    # Three files an hour apart; the last one only moves the watermark. Every task is held once or replaced, null ids count as one.
    first = [(f"t{i}", f"q{i % 3}", i % 5, 100 * hour, (102 + i % 50) * hour) for i in range(400)] + [(None, None, None, 100 * hour, 103 * hour)]
    second = [(f"t{i}", None, 9, 101 * hour + i % 2, 104 * hour) for i in range(0, 400, 7)] + [(None, "n", None, 101 * hour, 105 * hour)]
    older = [(f"t{i}", "old", 7, 100 * hour - 1, 103 * hour) for i in range(0, 400, 5)]
    end = 121 * hour
    for rows in (first, second + older, [("end", "q", 1, end, None)]):
        df = spark.createDataFrame(rows, schema).select("task_id", "queue_name", "priority", *[F.timestamp_seconds(c).alias(n) for c, n in (("at", "created_at"), ("due", "execute_after"))])
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stateful.delayed_release(intake.stream_folder(spark, str(tmp_path / "in"), df.schema, 1), "1 hour", buckets)
    query = intake.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    held = {r[0]: r for r in first}
    held |= {r[0]: r for r in second}
    out = [(r.task_id, r.queue_name, r.priority, r.us) for r in spark.read.parquet(str(tmp_path / "out")).where("held").selectExpr("*", "unix_micros(cast(released_at AS timestamp)) DIV 1000000 AS us").collect()]
    # A task that is due just where the watermark stands is released.
    assert sorted(map(str, out)) == sorted(str((t, q, p, due)) for t, q, p, _, due in held.values() if due <= end - hour)
    assert any(r[4] == end - hour for r in held.values())
    # One value and its timer, kept in both orders, per bucket.
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 3 * buckets


def test_dedup_keeps_one_row_per_id(spark, event_log, folder):
    stream = windows.stream_dedup(streamed(spark, folder, event_log.schema), ["task_id"], "400 days")
    out = intake.run_and_read(spark, stream.select("task_id"), "dedup-test")
    assert out.count() == out.distinct().count() == views.event_columns(event_log).select("task_id").distinct().count()


def test_recovery_callback_sees_every_expired_lease(spark, event_log, folder, tmp_path):
    seen = []
    stream = stateful.lease_timeout(streamed(spark, folder, event_log.schema))
    sinks.run_with_callback(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp"))
    again = intake.run_and_read(spark, stateful.lease_timeout(streamed(spark, folder, event_log.schema)), "again")
    assert sum(seen) == again.count() > 0


def test_streams_over_one_file_and_over_a_folder_agree(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name, by in (("orders", "o_orderdate"), ("events", "ts")):
        whole = spark.read.parquet(f"{sf}/{name}.parquet")
        whole.repartitionByRange(3, by).sortWithinPartitions(by).write.parquet(str(tmp_path / f"{name}.parquet"))
    stream = intake.stream_table(spark, str(tmp_path), "events")
    for name in ("task_stream_source", "stream_dedup", "stream_at_least_once_sink"):
        one, many = (sorted(map(str, entry.queries()[name](spark, folder).collect())) for folder in (sf, str(tmp_path)))
        assert one and one == many
    assert stream.columns == spark.read.parquet(f"{sf}/events.parquet").columns


def test_a_missing_stream_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        intake.stream_table(spark, str(tmp_path), "orders")


def test_priority_batches_over_several_steps_lose_nothing(spark, tmp_path, monkeypatch):
    whole = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    source = intake.stream_table
    monkeypatch.setattr(intake, "stream_table", lambda spark, folder, name: source(spark, folder, name, 1))
    rows = entry.queries()["stream_priority_batch"](spark, str(tmp_path)).collect()
    assert sorted(r.task_id for r in rows) == sorted(str(r.o_orderkey) for r in whole.collect())
