"""Versioned task tables and mergeable rollups: what readers see, what is written again, and totals against a full scan."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from taskloom.operators import handlers, rollups
from taskloom.sources import views
from taskloom.sources.versions import VersionedTasks

SF = "/root/testdata/sf0.001"


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def ids(df):
    return sorted(r.task_id for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"t{i}", ["007", "7", "a/b", None][i % 4], i) for i in range(400)]
    tasks = spark.createDataFrame(rows, "task_id STRING, queue_name STRING, age INT").repartition(6)
    table = VersionedTasks(spark, str(tmp_path / "tasks"), tasks.schema)
    table.create(tasks)
    return table


def test_a_purge_writes_a_manifest_only(table):
    assert table.read().count() == 400 and table.read().filter("queue_name = '7'").count() == 100
    before, data = table.read(), bytes_below(f"{table.path}/data")
    table.purge(["a/b", "nobody"])
    assert before.count() == 400  # a reader of the old version
    assert table.read().count() == 300 and table.read(0).count() == 400
    assert bytes_below(f"{table.path}/data") == data
    assert table.read().filter("queue_name IS NULL").count() == 100


def test_a_broken_change_has_no_effect(table, monkeypatch):
    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(VersionedTasks, "commit", dies)
        for change in (lambda: table.purge(["7"]), lambda: table.retain(lambda t: t.filter("age < 10")), table.compact):
            with pytest.raises(RuntimeError):
                change()
            assert table.read().count() == 400 and table.version() == 0
    table.commit([("x", [])], 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        table.commit([("y", [])], 1)


def test_retention_writes_only_queues_that_lose_rows(table):
    table.retain(lambda t: t.filter("queue_name IS DISTINCT FROM '7' OR age < 100"))
    assert ids(table.read()) == sorted(f"t{i}" for i in range(400) if i % 4 != 1 or i < 100)
    added = table._entries(1)[-1][0]
    assert [d for d in os.listdir(f"{table.path}/data/{added}") if "=" in d] == ["queue_name=7"]
    version = table.version()
    table.retain(lambda t: t.filter("age >= 0"))
    assert table.version() == version


def test_vacuum_shrinks_storage(table):
    table.purge(["007"])
    table.retain(lambda t: t.filter("age < 40"))
    table.compact()
    left = ids(table.read())
    assert left == sorted(f"t{i}" for i in range(40) if i % 4 != 0)
    before = bytes_below(f"{table.path}/data")
    table.vacuum()
    assert bytes_below(f"{table.path}/data") < before and ids(table.read()) == left


def test_null_queues_are_kept_by_retention(table):
    """Rows without a queue are neither cleared by a name nor lost."""
    table.purge(["007", "7", "a/b"])
    assert ids(table.read()) == sorted(f"t{i}" for i in range(3, 400, 4))


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_rollups_equal_the_full_scan_and_late_events_rewrite_one_day(spark, tmp_path):
    events = views.task_events(spark, SF)
    path = str(tmp_path / "rollups")
    late = (F.col("event_id") % 5 == 0) & (F.to_date("ts") == "2024-01-05")
    closed = F.col("ts") < "2024-01-20"
    rollups.write_rollups(rollups.rollup(events.filter(closed & ~late)), path)
    files = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    rollups.refresh(events, path, ["2024-01-05"])
    again = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    assert [d for d in files if files[d] != again[d]] == ["day=2024-01-05"] and files.keys() == again.keys()
    for keys in (["task_type"], ["queue_name", "task_type"]):
        found = rollups.merged(spark, path, events.filter(~closed), keys)
        value = F.when((F.col("kind") == "completed") & (F.col("processing_s") > 0), F.col("processing_s"))
        whole = events.groupBy(*keys).agg(
            *[F.count_if(F.col("kind") == k).alias(k) for k in rollups.KINDS], F.count(value).alias("samples"),
            F.min(value).alias("low_s"), F.max(value).alias("high_s"), F.count_if(value <= 1.0).alias("at_1"),
        )
        one = found.withColumn("at_1", F.col("cumulative")[list(rollups.LATENCY_BUCKETS).index(1)])
        assert rows(one.select(whole.columns)) == rows(whole)
        assert found.filter("cumulative[size(cumulative) - 1] <> samples").count() == 0


def test_one_pass_calls_the_callback_once_per_failed_row(spark):
    rng = random.Random(2)
    calls = spark.sparkContext.accumulator(0)

    def shout(data):
        if "bad" in data:
            raise KeyError("bad one")
        return data.upper()

    def noted(task, error):
        calls.add(1)
        return None if task["task_id"].endswith("7") else f"{task['task_id']} {type(error).__name__}"

    data = [(f"t{i}", rng.choice(["shout", "math", "gone", None]), rng.choice(["bad", "fine", '{"operation":"divide","a":1,"b":0}'])) for i in range(300)]
    routed = spark.createDataFrame(data, "task_id STRING, handler_kind STRING, data STRING").repartition(4)
    routed = routed.withColumns({"task_type": F.lit("x"), "error": F.when(F.col("handler_kind").isNull(), F.lit("no handler")), "extra": F.array(F.lit(1))})
    chosen = handlers.default_handlers().register_python("shout", shout)
    done = handlers.apply_handlers(routed, chosen, noted)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    out = {r.task_id: r for r in done.collect()}
    failed = [r for r in out.values() if r.error is not None]
    assert calls.value == len(failed) > 50 and len(out) == 300
    for task_id, kind, text in data:
        r = out[task_id]
        assert r.extra == [1] and (r.result is None) == (r.error is not None)
        if kind == "shout":
            assert (r.result, r.handler_s is not None) == ((None if "bad" in text else text.upper()), True)
        expected = None if r.error is None or task_id.endswith("7") else f"{task_id} {'KeyError' if kind == 'shout' else 'HandlerError'}"
        assert r.noted == expected
    assert "noted" not in handlers.apply_handlers(routed, chosen).columns
