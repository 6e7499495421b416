"""One metrics page over a task log: counters, gauges, rates, summaries; as columns, JSON or text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.text import fixed
from taskloom.functions.times import instant, plus_seconds, seconds_between
from taskloom.operators.metrics import (
    ACTIVE_CHANGES,
    DEPTH_CHANGES,
    change_of,
    clamped_timeline,
    counts_by_type,
    in_window,
    metric_summary,
    positive,
    success_rate,
)
from taskloom.operators.lifecycle import TASK_CHUNK_S
from taskloom.operators.ordered import by_time, last_seen, ordered_scan, running_level, sum_since
from taskloom.schema import DEFAULT_MAX_RETRIES, ERRORS_IN_SNAPSHOT, METRIC_WINDOW_S, RATE_WINDOW_S

COUNTERS = ["tasks_submitted", "tasks_completed", "tasks_failed", "tasks_retried", "tasks_dead_lettered"]

SUMMARY = ["count", "sum", "avg", "min", "max", "p50", "p95", "p99"]


def last_levels(events: DataFrame) -> DataFrame:
    """Queue depth and active tasks after each queue's last event, added over the queues; one scan for both."""
    moves = events.filter(F.col("kind").isin(list({**DEPTH_CHANGES, **ACTIVE_CHANGES})))
    measures = [running_level("queue_depth", change_of(DEPTH_CHANGES)), running_level("active_tasks", change_of(ACTIVE_CHANGES))]
    levels = ["queue_depth", "active_tasks"]
    latest = ordered_scan(moves, ["queue_name"], ["ts", "event_id"], by_time("ts"), measures).groupBy("queue_name").agg(
        F.max_by(F.struct(*levels), F.struct("ts", "event_id")).alias("latest")
    )
    return latest.agg(*[F.coalesce(F.sum(f"latest.{c}"), F.lit(0)).alias(c) for c in levels])


def metrics_row(
    events: DataFrame,
    workers: DataFrame,
    as_of: str,
    started_at: str,
    window_s: float = METRIC_WINDOW_S,
    rate_window_s: float = RATE_WINDOW_S,
) -> DataFrame:
    """All scalar metrics of the log up to ``as_of`` in one row. Each part is a one-row aggregate."""
    now = instant(events, "ts", as_of)
    log = events.filter(F.col("ts") <= now)
    kind = F.col("kind")
    uptime = seconds_between(now, instant(events, "ts", started_at))
    recent = F.col("ts") >= plus_seconds(now, F.lit(-rate_window_s))
    span = F.least(F.lit(float(rate_window_s)), uptime)
    counters = (
        log.agg(
            F.count_if(kind == "submitted").alias("tasks_submitted"),
            F.count_if(kind == "completed").alias("tasks_completed"),
            F.count_if(kind == "failed").alias("tasks_failed"),
            F.count_if(recent & (kind == "submitted")).alias("_submitted"),
            F.count_if(recent & (kind == "completed")).alias("_completed"),
        )
        .withColumns(
            {
                "uptime_seconds": uptime,
                "success_rate": success_rate(F.col("tasks_completed"), F.col("tasks_failed")),
                "submission_rate": F.coalesce(F.try_divide("_submitted", span), F.lit(0.0)),
                "throughput_rate": F.coalesce(F.try_divide("_completed", span), F.lit(0.0)),
            }
        )
        .drop("_submitted", "_completed")
    )
    done = in_window(events, as_of, window_s).filter(kind == "completed")
    summary = metric_summary(done, [], positive(F.col("processing_s")))
    running = workers.agg(F.count_if("running").alias("active_workers"))
    times = summary.select(*[F.col(c).alias(f"processing_{c}") for c in SUMMARY])
    # One row each; without samples the summary has none and its columns are null.
    return beside(counters, last_levels(log), running, times)


def failures_and_waits(events: DataFrame, as_of: str, window_s: float, max_retries: int = DEFAULT_MAX_RETRIES) -> DataFrame:
    """One row: failures that led to a retry and those that used the retries up, and a summary of the waits of the trailing window.

    A submission or a completion starts a task's count of failures over, and so does its death. A wait is the time from a task's latest submission
    to a start; both come from one scan of the log, and the ranks of the waits are selected by their bits.
    """
    order, kind, now = ["ts", "event_id"], F.col("kind"), instant(events, "ts", as_of)
    log = events.filter((F.col("ts") <= now) & kind.isin("submitted", "started", "completed", "failed"))
    failed = kind == "failed"
    scanned = ordered_scan(
        log,
        ["task_id"],
        order,
        by_time("ts", TASK_CHUNK_S),
        [
            sum_since("_failures", failed.cast("long"), kind.isin("submitted", "completed"), order),
            last_seen("_submitted", F.when(kind == "submitted", F.col("ts")), order),
        ],
    )
    used_up = F.col("_failures") % F.greatest(F.lit(max_retries), F.lit(1)) == 0
    wait = F.when(kind == "started", positive(seconds_between(F.col("ts"), F.col("_submitted"))))
    counts = scanned.agg(
        F.count_if(failed & ~used_up).alias("tasks_retried"), F.count_if(failed & used_up).alias("tasks_dead_lettered")
    )
    waits = metric_summary(in_window(scanned, as_of, window_s), [], wait)
    return beside(counts, waits.select(*[F.col(c).alias(f"wait_{c}") for c in SUMMARY]))


def depth_stats(events: DataFrame, as_of: str, window_s: float) -> DataFrame:
    """One row: average, lowest and highest depth over the changes of the trailing window."""
    log = events.filter(F.col("ts") <= instant(events, "ts", as_of))
    depths = clamped_timeline(log, DEPTH_CHANGES, "depth", ["queue_name"])
    return in_window(depths, as_of, window_s).agg(
        F.count("depth").alias("depth_count"), F.avg("depth").alias("depth_avg"),
        F.min("depth").cast("double").alias("depth_min"), F.max("depth").cast("double").alias("depth_max"),
    )


def beside(row: DataFrame, *parts: DataFrame) -> DataFrame:
    """Tables of one row each as one; a part without a row gives nulls."""
    row = row.withColumn("_one", F.lit(1))
    for part in parts:
        row = row.join(part.withColumn("_one", F.lit(1)), "_one", "left")
    return row.drop("_one")


def snapshot_row(
    events: DataFrame, workers: DataFrame, as_of: str, started_at: str, window_s: float = METRIC_WINDOW_S, rate_window_s: float = RATE_WINDOW_S
) -> DataFrame:
    """Everything in the snapshot that is one number."""
    return beside(
        metrics_row(events, workers, as_of, started_at, window_s, rate_window_s),
        failures_and_waits(events, as_of, window_s),
        depth_stats(events, as_of, window_s),
    )


def exposition_lines(row: DataFrame) -> DataFrame:
    """The metrics row as text exposition lines; the summary block is left out without samples."""

    def block(name: str, help_text: str, kind: str, value) -> list:
        return [
            F.lit(f"# HELP {name} {help_text}"),
            F.lit(f"# TYPE {name} {kind}"),
            F.concat(F.lit(f"{name} "), value.cast("string")),
        ]

    # Metric names, help texts and types of the exposition page.
    plain = [
        *block("tasks_submitted_total", "Total number of tasks submitted", "counter", F.col("tasks_submitted")),
        *block("tasks_completed_total", "Total number of tasks completed", "counter", F.col("tasks_completed")),
        *block("tasks_failed_total", "Total number of tasks failed", "counter", F.col("tasks_failed")),
        *block("queue_depth", "Current number of tasks in queue", "gauge", F.col("queue_depth")),
        *block("active_workers", "Number of active workers", "gauge", F.col("active_workers")),
        *block(
            "throughput_rate",
            "Current throughput in tasks per second",
            "gauge",
            fixed(F.col("throughput_rate"), 4),
        ),
    ]
    quantiles = [
        F.concat(F.lit(f'task_processing_seconds{{quantile="{q}"}} '), fixed(F.col(f"processing_{p}"), 4))
        for q, p in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))
    ]
    summary = [
        F.lit("# HELP task_processing_seconds Task processing time in seconds"),
        F.lit("# TYPE task_processing_seconds summary"),
        *quantiles,
        F.concat(F.lit("task_processing_seconds_sum "), fixed(F.col("processing_sum"), 4)),
        F.concat(F.lit("task_processing_seconds_count "), F.col("processing_count").cast("string")),
    ]
    lines = F.when(F.col("processing_count") > 0, F.array(*plain, *summary)).otherwise(F.array(*plain))
    return row.select(F.posexplode(lines).alias("pos", "line")).select(
        (F.col("pos") + 1).alias("line_no"), "line"
    )


def snapshot_document(
    row: DataFrame, by_type: DataFrame, errors: DataFrame, as_of: str
) -> DataFrame:
    """The nested snapshot as one JSON document.

    ``by_type`` is aggregated before it is collected into the document: one entry per task type.
    ``errors`` are the newest failures; the document shows the last few.
    """
    types = by_type.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_type", "tasks")))).alias("tasks_by_type"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_type", "failures")))).alias(
            "failures_by_type"
        ),
    )
    newest = errors.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(ERRORS_IN_SNAPSHOT)
    shown = newest.agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "task_type", "error"))).alias("recent_errors")
    )
    def summary(of: str, *stats: str) -> Column:
        """Null without samples."""
        return F.when(F.col(f"{of}_count") > 0, F.struct(*[F.col(f"{of}_{s}").alias(s) for s in stats]))

    shown_stats = [s for s in SUMMARY if s != "sum"]
    depth = F.struct(F.col("queue_depth").alias("current"), *[F.col(f"depth_{s}").alias(s) for s in ("avg", "min", "max")])
    doc = F.struct(
        F.lit(as_of).alias("timestamp"),
        "uptime_seconds",
        F.struct(*COUNTERS).alias("counters"),
        F.struct("queue_depth", "active_workers", "active_tasks").alias("gauges"),
        F.struct("submission_rate", "throughput_rate", "success_rate").alias("rates"),
        summary("processing", *shown_stats).alias("processing_times"),
        summary("wait", *shown_stats).alias("wait_times"),
        F.when(F.col("depth_count") > 0, depth).alias("queue_depth_stats"),
        "tasks_by_type",
        "failures_by_type",
        "recent_errors",
    )
    return beside(row, types, shown).select(F.to_json(doc).alias("snapshot"))


def document_values(document: DataFrame) -> DataFrame:
    """(section, name, value) of every number in a snapshot document, read back from its JSON; of the errors, the event's id."""
    whole = F.try_parse_json("snapshot")
    sections = ["counters", "gauges", "rates", "processing_times", "wait_times", "queue_depth_stats", "tasks_by_type", "failures_by_type"]

    def numbers(section: str) -> Column:
        held = F.map_entries(F.try_variant_get(whole, f"$.{section}", "map<string,double>"))
        return F.transform(held, lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("value")))

    errors = F.transform(
        F.try_variant_get(whole, "$.recent_errors", "array<struct<event_id:bigint,error:string>>"),
        lambda e: F.struct(F.lit("recent_errors").alias("section"), e["error"].alias("name"), e["event_id"].cast("double").alias("value")),
    )
    uptime = F.array(F.struct(F.lit("").alias("section"), F.lit("uptime_seconds").alias("name"), F.try_variant_get(whole, "$.uptime_seconds", "double").alias("value")))
    # A section without samples is null in the document and has no rows.
    every = F.flatten(F.array_compact(F.array(uptime, *map(numbers, sections), errors)))
    return document.select(F.explode(every).alias("x")).select("x.*")


def type_counts(events: DataFrame, as_of: str) -> DataFrame:
    return counts_by_type(events.filter(F.col("ts") <= instant(events, "ts", as_of)), ["task_type"])
