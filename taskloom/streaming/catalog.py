"""Named streaming queries: each streams a driver table to its end and returns what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions.times import instant
from taskloom.plans.catalog import query
from taskloom.session import scratch_path
from taskloom.sources import views
from taskloom.streaming import intake, pairing, sinks, stateful, windows

TAKE = 1000
TASK_SCHEMA = (
    "task_id STRING, queue_name STRING, priority INT, created_at TIMESTAMP_NTZ, "
    "execute_after TIMESTAMP_NTZ, max_retries INT"
)


def task_stream(spark, sf_dir) -> DataFrame:
    orders = intake.stream_table(spark, sf_dir, "orders")
    return orders.select(*[c.alias(n) for n, c in views.task_columns(with_payload=False).items()])


def event_stream(spark, sf_dir) -> DataFrame:
    """Watermarks need a time-zoned timestamp."""
    events = views.event_columns(intake.stream_table(spark, sf_dir, "events"))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query
def task_stream_source(spark, sf_dir):
    return intake.run_and_read(spark, task_stream(spark, sf_dir), "tasks")


@query
def stream_delayed_release(spark, sf_dir):
    tasks = task_stream(spark, sf_dir)
    tasks = tasks.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "execute_after")})
    return intake.run_and_read(spark, stateful.delayed_release(tasks, "36 hours"), "released")


@query
def stream_retry_dlq(spark, sf_dir):
    return intake.run_and_read(spark, stateful.retry_dlq(event_stream(spark, sf_dir)), "retries")


@query
def stream_lease_timeout(spark, sf_dir):
    return intake.run_and_read(spark, stateful.lease_timeout(event_stream(spark, sf_dir)), "expired")


@query
def stream_rolling_metrics(spark, sf_dir):
    rows = intake.run_and_read(spark, windows.rolling_metrics(event_stream(spark, sf_dir)), "rolling")
    rounded = rows.withColumns({c: F.round(c, 6) for c in ("total", "low", "high")})
    return plain_time(rounded, "start", "end").withColumnsRenamed({"start": "window_start", "end": "window_end"})


@query
def stream_late_drop(spark, sf_dir):
    """The log in two steps, then copies of its first days: they are too late and must not count.

    Late rows are judged by the watermark of the step before, so the copies come in a third step.
    """
    path = scratch_path(spark, "late")
    events = views.table(spark, sf_dir, "events")
    files, ts = 4, F.col("ts")

    def at(day: str):
        return instant(events, "ts", day)

    first, second = events.filter(ts < at("2024-01-15")), events.filter(ts >= at("2024-01-15"))
    for part in (first, second, events.filter(ts < at("2024-01-10"))):
        part.repartition(files).write.mode("append").parquet(f"{path}/in")
    stream = views.event_columns(intake.stream_folder(spark, f"{path}/in", events.schema, files))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windows.rolling_metrics(stream, "1 hour", "1 hour", "1 hour").select("start", "task_type", "events")
    rows = intake.run_and_read(spark, counted, "late-out")
    return plain_time(rows, "start").withColumnRenamed("start", "window_start")


@query
def stream_dedup(spark, sf_dir):
    submitted = event_stream(spark, sf_dir).filter(F.col("kind") == "submitted")
    first = windows.stream_dedup(submitted, ["task_id"], "60 days").select("task_id", "queue_name")
    return intake.run_and_read(spark, first, "distinct")


@query
def stream_priority_batch(spark, sf_dir):
    path = scratch_path(spark, "priority")
    step, last = sinks.priority_sink(path, TAKE, TASK_SCHEMA), [0]

    def followed(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id)
        last[0] = batch_id

    intake.run_each_batch(task_stream(spark, sf_dir), followed, f"{path}/checkpoint")
    kept = ["task_id", "queue_name", "priority"]
    backlog = sinks.Backlog(spark, path, TASK_SCHEMA)
    taken = backlog.taken().select(*kept, F.lit("taken").alias("disposition"))
    return taken.unionByName(backlog.waiting(last[0] + 1).select(*kept, F.lit("backlog").alias("disposition")))


@query
def stream_at_least_once_sink(spark, sf_dir):
    path = scratch_path(spark, "effects")
    intake.run_each_batch(task_stream(spark, sf_dir), sinks.idempotent_sink(f"{path}/out"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("task_id", "queue_name", "created_at")


@query
def stream_dead_letters(spark, sf_dir):
    """Tasks that the retry machine gives up on, into a table that takes each batch once."""
    path = scratch_path(spark, "dead-letters")
    dead = stateful.retry_dlq(event_stream(spark, sf_dir)).filter(F.col("kind") == "dead").drop("kind")
    intake.run_each_batch(dead, sinks.dead_letter_sink(f"{path}/table"), f"{path}/checkpoint")
    return sinks.ManifestTable(spark, f"{path}/table").read(dead.schema)


@query
def stream_attempt_pairs(spark, sf_dir):
    pairs = pairing.attempt_pairs(event_stream(spark, sf_dir), event_stream(spark, sf_dir))
    rows = intake.run_and_read(spark, pairs, "pairs")
    return plain_time(rows, "started_at", "finished_at").withColumn("processing_s", F.round("processing_s", 6))


@query
def stream_latest_submission(spark, sf_dir):
    """The last version of each submission; a repeat counts as one within three days."""
    latest = stateful.latest_submission(event_stream(spark, sf_dir), 3 * 86400)
    return intake.run_and_read(spark, latest, "latest")


@query
def stream_health(spark, sf_dir):
    rows = intake.run_and_read(spark, windows.stream_health(event_stream(spark, sf_dir)), "health")
    return plain_time(rows, "window_start").withColumn("success_rate", F.round("success_rate", 6))


@query
def recovery_callback(spark, sf_dir):
    """The callback puts the tasks of expired leases back to pending."""
    path = scratch_path(spark, "recovered")

    def requeue(batch: DataFrame, batch_id: int) -> None:
        back = batch.select("task_id", "worker_id", "expired_at", F.lit("pending").alias("state"))
        sinks.idempotent_sink(f"{path}/out")(back, batch_id)

    sinks.run_with_callback(stateful.lease_timeout(event_stream(spark, sf_dir)), requeue, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").drop("batch_id")
