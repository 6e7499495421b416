"""Documents in and out, routing, handlers and the batch worker path."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from taskloom.functions.payload import with_route
from taskloom.operators import handlers
from taskloom.plans.process_batch import process_batch
from taskloom.schema import TASK
from taskloom.sources import stores, task_json, views


def test_submission_rules(spark):
    good = {"priority": 5, "payload": {"type": "math"}}
    cases = [
        (good, None), ({**good, "priority": 0}, None), ({**good, "priority": 100}, None), ({**good, "priority": "7"}, None),
        ({**good, "priority": -1}, "priority"), ({**good, "priority": 101}, "priority"), ({**good, "priority": 1.5}, "priority"),
        ({"payload": {}}, "priority"), ({**good, "payload": "x"}, "payload"), ({**good, "payload": "{x"}, "payload"),
        ({**good, "payload": [1]}, "payload"), ({"priority": 1}, "payload"),
        ({**good, "max_retries": 0}, None), ({**good, "max_retries": 10}, None), ({**good, "max_retries": 11}, "max_retries"),
        ({**good, "max_retries": -1}, "max_retries"), ({**good, "execute_after": "2030-01-01T00:00:00"}, None),
        ({**good, "execute_after": 1900000000}, None), ({**good, "execute_after": "soon"}, "execute_after"),
    ]
    docs = [(i, json.dumps(d)) for i, (d, _) in enumerate(cases)] + [(99, '{"priority": 1, "payload": {}'), (100, "")]
    out = task_json.submit_validate(spark.createDataFrame(docs, "i INT, doc STRING"))
    rows = {r.i: r for r in out.collect()}
    assert {i: rows[i].reason for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}
    assert rows[99].reason == "malformed" and not rows[100].accepted
    assert rows[0].max_retries == 3 and rows[0].accepted and rows[3].priority == 7
    assert json.loads(rows[0].payload) == {"type": "math"}


def test_documents_round_trip(spark):
    df = spark.createDataFrame(
        [("a", "q", 1, '{"type":"math","data":{"a":1}}', "2024-01-01 00:00:00.5", None, 3, 2, "pending"),
         ("b", "q", 2, '{"data":"x"}', "2024-01-02 00:00:00", "2024-01-03 00:00:00", 0, 0, "dead")],
        "task_id STRING, queue_name STRING, priority INT, payload STRING, created_at STRING, execute_after STRING, "
        "max_retries INT, retry_count INT, status STRING",
    )
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "execute_after")})
    docs = task_json.task_encode(df)
    first = json.loads(docs.filter("task_id = 'a'").first().doc)
    assert first["payload"] == {"type": "math", "data": {"a": 1}} and first["execute_after"] is None
    assert first["created_at"] == 1704067200.5
    back = task_json.task_decode(docs).orderBy("task_id")
    kept = ["task_id", "priority", "created_at", "execute_after", "max_retries", "retry_count", "status"]
    assert back.filter("not quarantined").select(kept).collect() == df.orderBy("task_id").select(kept).collect()


def test_decode_defaults_and_quarantine(spark):
    docs = ['{"task_id":"a","priority":1,"payload":{},"created_at":0}', '{"task_id":"b"}',
            '{"task_id":"c","priority":1,"payload":{},"created_at":0,"status":"lost"}', "{"]
    out = task_json.task_decode(spark.createDataFrame([(d,) for d in docs], "doc STRING")).collect()
    assert [r.quarantined for r in out] == [False, True, True, True]
    assert (out[0].max_retries, out[0].retry_count, out[0].status) == (3, 0, "pending")
    assert out[3].raw == "{"


def test_defaults_give_unique_ids(spark):
    df = spark.range(50).select(
        F.lit(None).cast("string").alias("task_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("int").alias("retry_count"), F.lit(None).cast("int").alias("max_retries"),
        F.lit(None).cast("string").alias("status"),
    )
    rows = task_json.task_defaults(df).collect()
    assert len({r.task_id for r in rows}) == 50 and {r.max_retries for r in rows} == {3}


def test_route_of_odd_payloads(spark):
    payloads = ['{"type":"x","data":{"a":1}}', '{"data":5}', "plain", "[1,2]", '{"type":"y"}', None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i INT, payload STRING")
    rows = with_route(df).orderBy("i").collect()
    assert [(r.task_type, r.data) for r in rows] == [
        ("x", '{"a":1}'), ("default", "5"), ("default", "plain"), ("default", "[1,2]"), ("y", None), ("default", None),
    ]


def math(spark, *args):
    df = spark.createDataFrame([(json.dumps(a),) for a in args], "data STRING")
    parsed = df.withColumn("p", handlers.parse_math(F.col("data")))
    return [tuple(r) for r in parsed.select(handlers.math_outcome(F.col("p")).alias("o")).select("o.*").collect()]


def test_math_operations(spark):
    assert math(
        spark,
        {"operation": "add", "a": 2, "b": 3}, {"operation": "multiply", "a": 2, "b": 3}, {"operation": "divide", "a": 3, "b": 2},
        {"operation": "divide", "a": 3, "b": 0}, {"operation": "power"}, {"operation": "add", "a": 4}, {},
    ) == [
        (5.0, None), (6.0, None), (1.5, None), (None, "Division by zero"), (None, "Unknown operation: power"), (4.0, None),
        (None, "Unknown operation: None"),
    ]


def task_rows(spark, rows):
    """Rows of (id, type, data, max_retries, retry_count)."""
    df = spark.createDataFrame(
        [(i, "q", 1, json.dumps({"type": t, "data": d}), m, n) for i, t, d, m, n in rows],
        "task_id STRING, queue_name STRING, priority INT, payload STRING, max_retries INT, retry_count INT",
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumns({"created_at": start, "execute_after": F.lit(None).cast("timestamp_ntz")})


def registry(spark, **kinds):
    return spark.createDataFrame(list(kinds.items()), "task_type STRING, handler_kind STRING")


def test_batch_outcomes(spark):
    bad = {"operation": "divide", "a": 1, "b": 0}
    df = task_rows(spark, [
        ("ok", "sum", {"operation": "add", "a": 1, "b": 2}, 3, 0), ("again", "sum", bad, 3, 1), ("dead", "sum", bad, 3, 2),
        ("first", "sum", bad, 1, 0), ("lost", "nobody", {}, 0, 0), ("text", "echo", "hi", 3, 0),
    ])
    out = process_batch(df, registry(spark, sum="math", echo="simple"), "2024-01-01 00:00:10")
    rows = {r.task_id: r for r in out.collect()}
    assert {k: r.outcome for k, r in rows.items()} == {
        "ok": "completed", "again": "retry", "dead": "dead", "first": "dead", "lost": "dead", "text": "completed",
    }
    assert rows["ok"].result == "3.000000" and rows["text"].result == "Processed: hi"
    assert rows["again"].retry_count == 2 and str(rows["again"].next_execute_after) == "2024-01-01 00:00:14"
    assert rows["lost"].error == "No handler registered for task type: nobody"


def test_python_handlers_fail_per_row(spark):
    def shout(data: str) -> str:
        if data == "bad":
            raise RuntimeError("Failed processing")
        return data.upper()

    df = task_rows(spark, [("a", "t", "fine", 3, 0), ("b", "t", "bad", 3, 0), ("c", "m", {"operation": "add", "a": 1}, 3, 0), ("d", "u", "x", 3, 0)])
    chosen = handlers.default_handlers().register_python("shout", shout)
    routed = handlers.handler_route_join(with_route(df), registry(spark, t="shout", m="math", u="unbound"))
    done = handlers.apply_handlers(routed, chosen)
    rows = {r.task_id: (r.result, r.error) for r in done.collect()}
    assert rows == {
        "a": ("FINE", None), "b": (None, "Failed processing"), "c": ("1.000000", None),
        "d": (None, "No handler registered for task type: u"),
    }
    good, failed = handlers.split_errors(done)
    assert good.count() == 2 and failed.count() == 2


def test_stores(spark, tmp_path):
    df = views.tasks(spark, "/root/testdata/sf0.001").withColumns({"retry_count": F.lit(0), "status": F.lit("pending")})
    path = str(tmp_path / "tasks")
    stores.write_by_queue(df, path)
    only = stores.read_queue(spark, path, "q2")
    assert only.count() == df.filter("queue_name = 'q2'").count()
    assert "PartitionFilters: [isnotnull(queue_name" in only._jdf.queryExecution().toString()
    stores.replace_queues(df.filter("queue_name = 'q1'").limit(3), path)
    assert stores.read_queue(spark, path, "q1").count() == 3 and stores.read_queue(spark, path, "q2").count() == only.count()
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no INT, line STRING")
    stores.write_exposition(lines, str(tmp_path / "page"))
    assert [r.value for r in spark.read.text(str(tmp_path / "page")).collect()] == ["a", "b"]
    json_path = str(tmp_path / "json")
    df.write.json(json_path)
    assert stores.read_tasks(spark, json_path, TASK, "json").filter("task_id is null").count() == 0


def test_queues_are_cleared_and_names_stay_text(spark, tmp_path):
    path = str(tmp_path / "queues")
    rows = [("a", "007"), ("b", "7"), ("c", "a/b"), ("d", "x")]
    stores.write_by_queue(spark.createDataFrame(rows, "task_id STRING, queue_name STRING"), path)
    stores.clear_queues(spark, path, ["a/b", "x"])
    assert sorted((r.task_id, r.queue_name) for r in stores.read_queue(spark, path).collect()) == [("a", "007"), ("b", "7")]


def test_a_stored_null_payload_is_kept(spark):
    docs = ['{"task_id": "a", "priority": 1, "payload": null, "created_at": 1}', '{"task_id": "a", "priority": 1, "created_at": 1}']
    out = task_json.task_decode(spark.createDataFrame([(d,) for d in docs], "doc STRING")).collect()
    assert [r.quarantined for r in out] == [False, True]
