"""Named batch queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions.payload import task_type, with_route
from taskloom.functions.retry import backoff_seconds
from taskloom.functions.text import format_duration, format_number
from taskloom.functions.times import clock_text, instant, iso_text, seconds
from taskloom.operators import dispatch, handlers, health, leases, lifecycle, metrics, rates, rolling, rollups, workers
from taskloom.plans import snapshot
from taskloom.plans.process_batch import process_batch
from taskloom.session import configure, scratch_path
from taskloom.sources import stores, task_json, views
from taskloom.sources.versions import VersionedTasks

Query = Callable[[SparkSession, str], DataFrame]

TASK_AS_OF = "1998-06-15 00:00:00"
EVENT_AS_OF = "2024-01-15 12:00:00"
LOG_START = "2024-01-01 00:00:00"
TTL_S = 30 * 86400
DAY_S = 86400

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name; the session gets the runtime settings first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def states_of(spark: SparkSession, sf_dir: str, with_payload: bool = False) -> DataFrame:
    return lifecycle.task_states(
        views.tasks(spark, sf_dir, with_payload), views.attempts(spark, sf_dir, TASK_AS_OF), TASK_AS_OF
    )


def plan_of(spark: SparkSession, sf_dir: str, with_payload: bool = False) -> DataFrame:
    known = lifecycle.attempts_known(views.attempts(spark, sf_dir, TASK_AS_OF), TASK_AS_OF)
    return lifecycle.retry_plan(known, existing(spark, sf_dir, with_payload))


def existing(spark: SparkSession, sf_dir: str, with_payload: bool = False) -> DataFrame:
    tasks = views.tasks(spark, sf_dir, with_payload)
    return tasks.filter(F.col("created_at") <= instant(tasks, "created_at", TASK_AS_OF))


def dead_of(spark: SparkSession, sf_dir: str, with_payload: bool = False) -> DataFrame:
    return lifecycle.dead_letters(states_of(spark, sf_dir, with_payload))


def later_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.task_events(spark, sf_dir)
    return events.filter(F.col("ts") > instant(events, "ts", EVENT_AS_OF))


def leases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.open_leases(views.task_events(spark, sf_dir), EVENT_AS_OF)


def durations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.attempt_durations(views.attempts(spark, sf_dir), views.tasks(spark, sf_dir, False))


# Sources and sinks


@query
def task_scan(spark, sf_dir):
    return views.tasks(spark, sf_dir).withColumns(
        {"retry_count": F.lit(0), "status": F.lit("pending")}
    )


@query
def submit_validate(spark, sf_dir):
    checked = task_json.submit_validate(views.submissions(spark, sf_dir))
    return checked.select(
        "submission_id",
        "accepted",
        "reason",
        "priority",
        "max_retries",
        "execute_after",
        F.when(F.col("payload").isNotNull(), task_type(F.col("payload"))).alias("task_type"),
    )


@query
def task_encode(spark, sf_dir):
    tasks = views.tasks(spark, sf_dir)
    return task_json.task_encode(tasks.withColumns({"retry_count": F.lit(0), "status": F.lit("pending")}))


@query
def task_decode(spark, sf_dir):
    return task_json.task_decode(views.stored_documents(spark, sf_dir))


@query
def namespaced_queue(spark, sf_dir):
    """Written by queue and read back: each queue is a directory of its own."""
    path = scratch_path(spark, "queues")
    stores.write_by_queue(views.tasks(spark, sf_dir, False), path)
    return stores.namespaced(stores.read_queue(spark, path)).select(
        "namespaced_key", "queue_name", "priority", "created_at"
    )


@query
def dlq_sink(spark, sf_dir):
    path = scratch_path(spark, "dlq")
    dead = dead_of(spark, sf_dir).select("task_id", "queue_name", "retry_count", "last_error", "dead_at")
    stores.append_dead_letters(dead, path)
    return spark.read.parquet(path).select("task_id", "queue_name", "retry_count", "last_error", "dead_at")


def metrics_row_of(spark, sf_dir):
    return snapshot.metrics_row(
        views.task_events(spark, sf_dir),
        views.workers(spark, sf_dir),
        EVENT_AS_OF,
        LOG_START,
        window_s=DAY_S,
        rate_window_s=DAY_S,
    )


@query
def prometheus_export(spark, sf_dir):
    return snapshot.exposition_lines(metrics_row_of(spark, sf_dir))


@query
def metrics_snapshot(spark, sf_dir):
    """All numbers of the nested document, read back from its JSON."""
    events = views.task_events(spark, sf_dir)
    failures = events.filter(
        (F.col("kind") == "failed") & (F.col("ts") <= instant(events, "ts", EVENT_AS_OF))
    ).withColumn("error", F.concat(F.lit("failed on "), F.col("worker_id")))
    row = snapshot.snapshot_row(
        events, views.workers(spark, sf_dir), EVENT_AS_OF, LOG_START, window_s=DAY_S, rate_window_s=DAY_S
    )
    document = snapshot.snapshot_document(row, snapshot.type_counts(events, EVENT_AS_OF), failures, EVENT_AS_OF)
    return snapshot.document_values(document).withColumn("value", F.round("value", 6))


@query
def metrics_snapshot_row(spark, sf_dir):
    """The scalar part of the snapshot as columns."""
    row = metrics_row_of(spark, sf_dir)
    rounded = [
        F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in row.dtypes
    ]
    return row.select(*rounded)


@query
def completed_retention(spark, sf_dir):
    kept = lifecycle.completed_retention(states_of(spark, sf_dir), TASK_AS_OF, TTL_S)
    return kept.select("task_id", "queue_name", "state", "completed_at")


@query
def versioned_retention(spark, sf_dir):
    """One queue cleared and old completions dropped on storage, as versions of the table; read back."""
    columns = ["task_id", "queue_name", "state", "completed_at"]
    states = states_of(spark, sf_dir).select(*columns)
    table = VersionedTasks(spark, scratch_path(spark, "versions"), states.schema)
    table.create(states)
    table.purge(["q1"])
    table.retain(lambda tasks: lifecycle.completed_retention(tasks, TASK_AS_OF, TTL_S, "completed_at"))
    return table.read().select(*columns)


@query
def purge_report(spark, sf_dir):
    return dispatch.purge_report(states_of(spark, sf_dir))


# Projections and filters


@query
def ready_filter(spark, sf_dir):
    return dispatch.ready_filter(views.tasks(spark, sf_dir, False), TASK_AS_OF)


@query
def payload_route_fields(spark, sf_dir):
    return with_route(views.tasks(spark, sf_dir)).select("task_id", "task_type", "data")


@query
def task_view(spark, sf_dir):
    return views.tasks(spark, sf_dir).select(
        "task_id",
        "priority",
        F.lit("pending").alias("status"),
        seconds(F.col("created_at")).alias("created_at"),
        seconds(F.col("execute_after")).alias("execute_after"),
        F.lit(0).alias("retry_count"),
        "max_retries",
        "payload",
    )


@query
def derived_state(spark, sf_dir):
    return states_of(spark, sf_dir).select("task_id", "queue_name", "state", "retry_count", "execute_after")


@query
def transition_audit(spark, sf_dir):
    return lifecycle.transition_audit(views.task_events(spark, sf_dir)).select(
        "event_id", "task_id", "kind", "state_before", "verdict"
    )


@query
def lease_expired_filter(spark, sf_dir):
    return leases.lease_expired_filter(leases_of(spark, sf_dir), EVENT_AS_OF)


@query
def lease_time_remaining(spark, sf_dir):
    return leases.with_expiry(leases_of(spark, sf_dir), EVENT_AS_OF).select(
        "task_id", "worker_id", F.round("remaining_s", 6).alias("remaining_s"), "deadline", "expired"
    )


@query
def lease_near_expiry(spark, sf_dir):
    near = leases.lease_near_expiry(leases_of(spark, sf_dir), EVENT_AS_OF)
    return near.select("task_id", "worker_id", F.round("age_s", 6).alias("age_s"), "expired")


@query
def positive_samples(spark, sf_dir):
    rows = durations_of(spark, sf_dir)
    return rows.filter(F.col("wait_s") > 0).select("task_id", "attempt_no", "wait_s", "processing_s")


@query
def dlq_page(spark, sf_dir):
    page = dispatch.dlq_page(dead_of(spark, sf_dir), limit=100, offset=50)
    return page.select("task_id", "queue_name", "retry_count", "dead_at")


@query
def stale_filter(spark, sf_dir):
    stale = leases.stale_filter(states_of(spark, sf_dir), TASK_AS_OF)
    return stale.select("task_id", "queue_name", "priority", "age_s", F.col("state").alias("status"))


# Joins


@query
def detail_lookup(spark, sf_dir):
    ids = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("task_id"))
    return dispatch.detail_lookup(ids, existing(spark, sf_dir, True)).select("task_id", "priority", "payload")


@query
def handler_route_join(spark, sf_dir):
    ready = with_route(dispatch.ready_filter(views.tasks(spark, sf_dir), TASK_AS_OF))
    return handlers.handler_route_join(ready, views.handlers(spark)).select(
        "task_id", "task_type", "handler_kind", "error"
    )


@query
def lookup_with_dlq_fallback(spark, sf_dir):
    states = states_of(spark, sf_dir).select("task_id", "queue_name", "state", "retry_count")
    requested = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"))
    return dispatch.lookup_in_states(requested, states)


@query
def lease_action_check(spark, sf_dir):
    later = later_events(spark, sf_dir)
    requests = later.filter(F.col("kind").isin("extended", "completed", "failed")).select(
        "event_id",
        "task_id",
        "worker_id",
        F.when(F.col("kind") == "extended", "extend").otherwise("release").alias("action"),
    )
    return leases.lease_action_check(requests, leases_of(spark, sf_dir))


@query
def lease_conflicts(spark, sf_dir):
    requests = later_events(spark, sf_dir).filter(F.col("kind") == "started")
    return leases.lease_conflicts(requests, leases_of(spark, sf_dir)).select(
        "event_id", "task_id", "worker_id", "holder", "outcome"
    )


@query
def visible_tasks(spark, sf_dir):
    ready = dispatch.ready_filter(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    known = lifecycle.attempts_known(views.attempts(spark, sf_dir, TASK_AS_OF), TASK_AS_OF)
    held = known.filter(F.col("outcome") == "running").select(
        "task_id", F.col("started_at").alias("lease_time"), F.lit(300.0).alias("timeout_s")
    )
    return leases.visible_tasks(ready, held, TASK_AS_OF)


@query
def apply_completions(spark, sf_dir):
    processing = leases_of(spark, sf_dir)
    completions = later_events(spark, sf_dir).filter(F.col("kind") == "completed")
    return lifecycle.apply_completions(processing.select("task_id", "worker_id"), completions)


@query
def attempt_durations(spark, sf_dir):
    return durations_of(spark, sf_dir).select(
        "task_id", "attempt_no", "outcome", "processing_s", "wait_s", "wait_from_due_s"
    )


@query
def event_attempts(spark, sf_dir):
    rows = lifecycle.event_attempts(views.task_events(spark, sf_dir))
    return rows.withColumn("processing_s", F.round("processing_s", 6)).drop("queue_name")


@query
def type_failure_rate(spark, sf_dir):
    rows = metrics.type_failure_rate(views.task_events(spark, sf_dir))
    return rows.withColumn("failure_rate", F.round("failure_rate", 6))


# Aggregations


@query
def lifecycle_counters(spark, sf_dir):
    return metrics.lifecycle_counters(states_of(spark, sf_dir), ["queue_name"])


@query
def counts_by_type(spark, sf_dir):
    return metrics.counts_by_type(views.task_events(spark, sf_dir), ["task_type"])


@query
def counts_by_type_priority(spark, sf_dir):
    return metrics.counts_by_type(views.task_events(spark, sf_dir), ["task_type", "priority"])


@query
def queue_stats(spark, sf_dir):
    return metrics.queue_stats(states_of(spark, sf_dir))


@query
def queue_size(spark, sf_dir):
    return metrics.queue_size(states_of(spark, sf_dir))


def rounded_summary(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("sum", "min", "max", "avg", "p50", "p95", "p99") if c in df.columns})


@query
def metric_summary(spark, sf_dir):
    events = views.task_events(spark, sf_dir).filter(F.col("kind") == "completed")
    return rounded_summary(
        metrics.metric_summary(events, ["task_type"], metrics.positive(F.col("processing_s")))
    )


@query
def wait_summary(spark, sf_dir):
    """The same summary over wait times, for all queues together."""
    waits = durations_of(spark, sf_dir)
    return rounded_summary(metrics.metric_summary(waits, [], metrics.positive(F.col("wait_s"))))


@query
def success_rate(spark, sf_dir):
    counts = metrics.lifecycle_counters(states_of(spark, sf_dir), ["queue_name"])
    rate = metrics.success_rate(F.col("completed"), F.col("failed"))
    return counts.select("queue_name", "completed", "failed", F.round(rate, 6).alias("success_rate"))


@query
def latency_histogram(spark, sf_dir):
    samples = durations_of(spark, sf_dir)
    return metrics.latency_histogram(
        samples, {"processing": F.col("processing_s"), "wait": F.col("wait_s")}
    ).withColumn("sum", F.round("sum", 6))


@query
def event_latency_histogram(spark, sf_dir):
    """Processing times of the event log, which spread over all buckets."""
    done = views.task_events(spark, sf_dir).filter(F.col("kind") == "completed")
    rows = metrics.latency_histogram(done, {"processing": F.col("processing_s")})
    return rows.withColumn("sum", F.round("sum", 6))


@query
def rollup_totals(spark, sf_dir):
    """Totals per type from rollups of the closed days and the open day's events. A part of one day comes late and rewrites that day."""
    events = views.task_events(spark, sf_dir)
    path = scratch_path(spark, "rollups")
    at = lambda day: instant(events, "ts", day)
    late = (F.col("ts") >= at("2024-01-03 12:00:00")) & (F.col("ts") < at("2024-01-04"))
    closed = F.col("ts") < at("2024-01-15")
    rollups.write_rollups(rollups.rollup(events.filter(closed & ~late)), path)
    rollups.refresh(events, path, ["2024-01-03"])
    totals = rollups.merged(spark, path, events.filter(~closed), ["task_type"])
    rounded = {c: F.round(c, 6) for c in ("total_s", "low_s", "high_s")}
    return totals.withColumns({**rounded, "cumulative": F.array_join("cumulative", ",")})


@query
def lease_stats(spark, sf_dir):
    stats = leases.lease_stats(leases_of(spark, sf_dir), EVENT_AS_OF)
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_lease_s", "max_lease_s")})


def sessions_of(spark, sf_dir):
    return leases.lease_sessions(views.task_events(spark, sf_dir), EVENT_AS_OF)


@query
def lease_counters(spark, sf_dir):
    return leases.lease_counters(sessions_of(spark, sf_dir))


def worker_stats_of(spark, sf_dir):
    started = views.task_events(spark, sf_dir).filter(F.col("kind") == "started")
    return workers.worker_stats(views.workers(spark, sf_dir), leases_of(spark, sf_dir), started)


@query
def worker_stats(spark, sf_dir):
    return worker_stats_of(spark, sf_dir)


@query
def pool_stats(spark, sf_dir):
    return workers.pool_stats(worker_stats_of(spark, sf_dir))


@query
def load_distribution(spark, sf_dir):
    done = views.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") != "R")
    done = done.select(F.concat(F.lit("w"), F.col("l_suppkey").cast("string")).alias("worker_id"))
    rows = workers.load_distribution(views.workers(spark, sf_dir), done)
    return rows.withColumn("share", F.round("share", 9))


def health_of(spark, sf_dir):
    states = states_of(spark, sf_dir)
    counts = metrics.lifecycle_counters(states, ["queue_name"])
    rate = metrics.success_rate(F.col("completed"), F.col("failed"))
    p95 = metrics.metric_summary(states, ["queue_name"], F.col("processing_s")).select("queue_name", "p95")
    running = views.workers(spark, sf_dir).agg(F.count_if("running")).scalar()
    rows = (
        counts.select("queue_name", rate.alias("success_rate"), F.col("backlog").alias("queue_depth"))
        .join(p95, "queue_name", "left")
        .withColumn("active_workers", running)
    )
    return health.health_status(rows)


@query
def health_status(spark, sf_dir):
    return health_of(spark, sf_dir).withColumn("success_rate", F.round("success_rate", 6))


@query
def dlq_summary(spark, sf_dir):
    dead = dead_of(spark, sf_dir, True).withColumns(
        {"task_type": task_type(F.col("payload")), "error": F.col("last_error")}
    )
    return metrics.dlq_summary(dead, ["task_type", "error"])


@query
def submission_throughput_rate(spark, sf_dir):
    events = views.task_events(spark, sf_dir)
    both = metrics.window_rates(events, EVENT_AS_OF, LOG_START, metrics.MINUTE | {"_day": DAY_S})
    return both.select("queue_name", *[F.round(c, 9).alias(c) for c in both.columns if c != "queue_name"])


# Ordered and rolling


@query
def dispatch_order(spark, sf_dir):
    ready = dispatch.ready_filter(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    return dispatch.dispatch_order(ready).select("task_id", "queue_name", "priority", "position")


@query
def rolling_summary(spark, sf_dir):
    return rounded_summary(
        rolling.rolling_summary(views.task_events(spark, sf_dir), ["queue_name"], F.col("processing_s"))
    )


@query
def rolling_rate(spark, sf_dir):
    submitted = views.task_events(spark, sf_dir).filter(F.col("kind") == "submitted")
    rows = rolling.rolling_rate(submitted, ["queue_name"], LOG_START)
    return rows.withColumn("rate", F.round("rate", 9))


@query
def queue_depth_timeline(spark, sf_dir):
    rows = metrics.clamped_timeline(
        views.task_events(spark, sf_dir), metrics.DEPTH_CHANGES, "depth", ["queue_name"]
    )
    return rows.select("event_id", "queue_name", "depth")


@query
def queue_depth_rolling(spark, sf_dir):
    """Average, lowest and highest depth over the trailing five minutes."""
    depth = metrics.clamped_timeline(
        views.task_events(spark, sf_dir), metrics.DEPTH_CHANGES, "depth", ["queue_name"]
    )
    rows = rolling.rolling_summary(depth, ["queue_name"], F.col("depth"))
    return rows.select("queue_name", "ts", "min", "max", F.round("avg", 6).alias("avg"))


@query
def active_task_timeline(spark, sf_dir):
    rows = metrics.clamped_timeline(
        views.task_events(spark, sf_dir), metrics.ACTIVE_CHANGES, "active", ["queue_name"]
    )
    return rows.select("event_id", "queue_name", "active")


@query
def recent_errors(spark, sf_dir):
    failed = plan_of(spark, sf_dir).filter(F.col("disposition").isin("retry", "dead"))
    text = F.concat(
        F.lit("attempt "), F.col("attempt_no"), F.lit(" of task "), F.col("task_id"),
        F.lit(" failed on worker "), F.col("worker_id"), F.lit(" with error code "), F.col("error"),
    )
    rows = metrics.recent_errors(
        failed.withColumn("error", text), ["queue_name"], ["finished_at", "task_id", "attempt_no"]
    )
    return rows.select("queue_name", "recency", "task_id", "attempt_no", "error", "shown")


@query
def rate_limit_audit(spark, sf_dir):
    started = views.task_events(spark, sf_dir).filter(F.col("kind") == "started")
    rows = rates.rate_limit_audit(started, rate=1 / 600)
    return rows.select("event_id", "queue_name", F.round("gap_s", 6).alias("gap_s"), "too_early")


@query
def rate_limited_schedule(spark, sf_dir):
    ready = dispatch.ready_filter(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    due = ready.withColumn("ready_at", F.greatest("created_at", "execute_after"))
    rows = rates.rate_limited_schedule(due, TASK_AS_OF, rate=5)
    return rows.select("task_id", "queue_name", "ready_at", "release_no", "release_at")


@query
def retry_plan(spark, sf_dir):
    rows = lifecycle.retry_plan(views.attempts(spark, sf_dir), views.tasks(spark, sf_dir, False))
    return rows.filter(F.col("outcome") == "failed").select(
        "task_id", "attempt_no", "retry_count", "disposition", "backoff_s", "next_execute_after", "error"
    )


@query
def current_task_state(spark, sf_dir):
    rows = lifecycle.current_events(views.task_events(spark, sf_dir), EVENT_AS_OF)
    return rows.select("task_id", "kind", "ts", "event_id", "worker_id", "task_type", "priority")


@query
def capacity_admission(spark, sf_dir):
    tasks = views.tasks(spark, sf_dir, False)
    arrivals = tasks.filter(F.col("created_at") > instant(tasks, "created_at", TASK_AS_OF))
    depth = metrics.queue_size(states_of(spark, sf_dir))
    rows = dispatch.capacity_admission(arrivals, depth, max_size=1000)
    return rows.select("task_id", "queue_name", "arrival", "depth", "accepted")


@query
def admission_log(spark, sf_dir):
    """Arrivals of the event log against queues of 40 places that starts make room in."""
    rows = dispatch.admission_log(views.task_events(spark, sf_dir), max_size=40)
    return rows.select("event_id", "queue_name", "kind", "depth_before", "depth", "accepted")


@query
def lease_effective_deadline(spark, sf_dir):
    return sessions_of(spark, sf_dir)


# Top-k and listings


@query
def next_k_tasks(spark, sf_dir):
    ready = dispatch.ready_filter(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    return dispatch.next_k(ready, 100).select("task_id", "queue_name", "priority", "created_at")


@query
def next_k_per_queue(spark, sf_dir):
    ready = dispatch.ready_filter(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    rows = dispatch.next_k_per_queue(ready, 25, ["queue_name"])
    return rows.select("task_id", "queue_name", "priority", "created_at", "position")


@query
def delayed_due_order(spark, sf_dir):
    delayed = dispatch.delayed_filter(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    return delayed.orderBy("execute_after", "task_id").select("task_id", "queue_name", "execute_after")


@query
def dlq_listing(spark, sf_dir):
    return dispatch.dlq_listing(dead_of(spark, sf_dir)).select(
        "task_id", "queue_name", "retry_count", "last_error", "dead_at"
    )


# Set operations


@query
def backlog_union(spark, sf_dir):
    rows = dispatch.backlog_union(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    return rows.select("task_id", "queue_name", "origin", "execute_after")


@query
def promote_delayed(spark, sf_dir):
    backlog = dispatch.backlog_union(views.tasks(spark, sf_dir, False), TASK_AS_OF)
    rows = dispatch.promote_delayed(backlog, "1998-06-22 00:00:00")
    return rows.select("task_id", "queue_name", "origin", "destination")


@query
def requeue_expired(spark, sf_dir):
    rows = leases.requeue_expired(leases_of(spark, sf_dir), EVENT_AS_OF)
    return rows.select("task_id", "queue_name", "state")


# Scalar functions


@query
def task_defaults(spark, sf_dir):
    """The filled fields; of the random ids, only whether each is the given one or a uuid, and how many rows have it."""
    tasks = views.tasks(spark, sf_dir, False).withColumn("given_id", F.col("task_id"))
    unnamed = tasks.withColumn("task_id", F.when(F.col("execute_after").isNull(), F.col("task_id")))
    unset = F.lit(None)
    filled = task_json.task_defaults(
        unnamed.withColumns({"retry_count": unset.cast("int"), "status": unset.cast("string")})
    )
    path = scratch_path(spark, "defaults")
    filled.select("given_id", "task_id", "retry_count", "max_retries", "status").write.parquet(path)
    uuid = F.col("task_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    source = F.when(F.col("task_id") == F.col("given_id"), "given").when(uuid, "uuid").otherwise("other")
    rows = spark.read.parquet(path).withColumn("id_source", source)
    kept = ["given_id", "id_source", "retry_count", "max_retries", "status"]
    return rows.groupBy("task_id").agg(F.count("*").alias("id_rows"), *[F.min(c).alias(c) for c in kept]).drop("task_id")


@query
def backoff_schedule(spark, sf_dir):
    """Back-off of every failure count that occurs in the log."""
    plan = plan_of(spark, sf_dir).filter(F.col("disposition") == "retry")
    return (
        plan.groupBy("retry_count")
        .agg(F.count("*").alias("retries"))
        .withColumn("backoff_s", backoff_seconds(F.col("retry_count")))
    )


QUERIES["backoff_seconds"] = QUERIES.pop("backoff_schedule")


@query
def epoch_iso_convert(spark, sf_dir):
    return views.task_events(spark, sf_dir).select(
        "event_id",
        seconds(F.col("ts")).alias("epoch_s"),
        iso_text(F.col("ts")).alias("iso"),
        clock_text(F.col("ts")).alias("clock"),
    )


@query
def format_numbers(spark, sf_dir):
    price = F.col("l_extendedprice")
    return views.table(spark, sf_dir, "lineitem").select(
        price.alias("price"),
        format_number(price).alias("price_text"),
        format_number(price / 100).alias("small_text"),
        format_number(price * 100).alias("large_text"),
        format_number(F.col("l_discount") + F.col("l_tax"), 1).alias("one_place"),
    )


QUERIES["format_number"] = QUERIES.pop("format_numbers")


@query
def format_durations(spark, sf_dir):
    value = F.col("value")
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        format_duration(value).alias("as_seconds"),
        format_duration(value / 1000).alias("as_millis"),
        format_duration(value * 60).alias("as_minutes"),
    )


QUERIES["format_duration"] = QUERIES.pop("format_durations")


@query
def check_titles(spark, sf_dir):
    return health.check_titles(health_of(spark, sf_dir), ["queue_name"])


@query
def math_tasks(spark, sf_dir):
    routed = with_route(views.tasks(spark, sf_dir))
    args = routed.withColumn("args", handlers.parse_math(F.col("data")))
    done = args.withColumn("out", handlers.math_outcome(F.col("args")))
    return done.select("task_id", F.round("out.value", 6).alias("value"), "out.error")


# Handlers


def routed_of(spark, sf_dir):
    ready = with_route(dispatch.ready_filter(views.tasks(spark, sf_dir), TASK_AS_OF))
    return handlers.handler_route_join(ready, views.handlers(spark))


@query
def apply_handlers(spark, sf_dir):
    done = handlers.apply_handlers(routed_of(spark, sf_dir), handlers.default_handlers())
    return done.select("task_id", "task_type", "handler_kind", "result", "error")


def word_count(data: str) -> str:
    """A handler in plain Python: it fails on operations it does not know."""
    import json

    fields = json.loads(data)
    if fields["operation"] == "power":
        raise ValueError(f"cannot handle {fields['operation']}")
    return f"{fields['operation']} with {len(fields)} fields"


@query
def error_side_output(spark, sf_dir):
    """A Python handler's exceptions as error rows, split off from the written outcome."""
    registry = handlers.default_handlers().register_python("simple", word_count)
    done = handlers.apply_handlers(routed_of(spark, sf_dir), registry)
    path = scratch_path(spark, "handled")
    done.select("task_id", "task_type", "handler_kind", "result", "error").write.parquet(path)
    _, failed = handlers.split_errors(spark.read.parquet(path))
    return failed.select("task_id", "task_type", "error")


@query
def error_callback(spark, sf_dir):
    """What the error callback makes of each failed row; all handlers and the callback run in one pass."""
    registry = handlers.default_handlers().register_python("simple", word_count)
    done = handlers.apply_handlers(routed_of(spark, sf_dir), registry, alert)
    return done.filter(F.col("error").isNotNull()).select("task_id", "noted")


def alert(task: dict, error: Exception) -> str:
    return f"{type(error).__name__} in {task['task_type']}: {error}"


@query
def process_ready_batch(spark, sf_dir):
    return process_batch(views.tasks(spark, sf_dir), views.handlers(spark), TASK_AS_OF)


QUERIES["process_batch"] = QUERIES.pop("process_ready_batch")
