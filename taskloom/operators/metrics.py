"""Counters, rates, summaries, histograms, timelines and error lists over task logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.text import shorten
from taskloom.functions.times import instant, plus_seconds, seconds_between
from taskloom.operators.ordered import HOUR_S, by_time, ordered_scan, running_level
from taskloom.operators.ranks import GROUP, ranked_values
from taskloom.schema import (
    ERROR_TEXT_KEPT,
    ERROR_TEXT_SHOWN,
    ERRORS_KEPT,
    LATENCY_BUCKETS,
    RATE_WINDOW_S,
)


MINUTE = {"": RATE_WINDOW_S}


def in_window(events: DataFrame, as_of: str, window_s: float, ts: str = "ts") -> DataFrame:
    """Rows of the trailing window, both ends included."""
    now = instant(events, ts, as_of)
    return events.filter((F.col(ts) >= plus_seconds(now, F.lit(-window_s))) & (F.col(ts) <= now))


def positive(column: Column) -> Column:
    """Only samples above zero reach summaries and histograms."""
    return F.when(column > 0, column)


def lifecycle_counters(states: DataFrame, keys: list[str]) -> DataFrame:
    """Submitted, started, completed, failed, retried and dead-lettered per key, and the backlog.

    Each event counts once; the task states already hold one row per task with its attempts counted.
    """
    state = F.col("state")
    return (
        states.groupBy(*keys)
        .agg(
            F.count("*").alias("submitted"),
            F.sum("attempts").alias("started"),
            F.count_if(state == "completed").alias("completed"),
            F.sum("retry_count").alias("failed"),
            F.count_if(state == "dead").alias("dead_lettered"),
            F.count_if(state.isin("pending", "delayed")).alias("backlog"),
        )
        .withColumn("retried", F.col("failed") - F.col("dead_lettered"))
    )


def success_rate(completed: Column, failed: Column) -> Column:
    return F.coalesce(F.try_divide(completed, completed + failed) * 100, F.lit(100.0))


def counts_by_type(events: DataFrame, keys: list[str]) -> DataFrame:
    kind = F.col("kind")
    return events.groupBy(*keys).agg(
        F.count_if(kind == "submitted").alias("tasks"), F.count_if(kind == "failed").alias("failures")
    )


def type_failure_rate(events: DataFrame) -> DataFrame:
    """Failures in percent of tasks, 0 where a type has no tasks; one conditional pass instead of a join."""
    rate = F.coalesce(F.try_divide("failures", "tasks") * 100, F.lit(0.0))
    return counts_by_type(events, ["task_type"]).withColumn("failure_rate", rate)


def queue_stats(states: DataFrame) -> DataFrame:
    """Rows per state and queue. ``backlog`` is pending as a store without a delayed set counts it."""
    state = F.col("state")
    return states.groupBy("queue_name").agg(
        F.count_if(state == "pending").alias("pending"),
        F.count_if(state == "processing").alias("processing"),
        F.count_if(state == "delayed").alias("delayed"),
        F.count_if(state == "dead").alias("dead_letters"),
        F.count("*").alias("total_tasks"),
        F.count_if(state.isin("pending", "delayed")).alias("backlog"),
    )


def queue_size(states: DataFrame) -> DataFrame:
    return states.groupBy("queue_name").agg(
        F.count_if(F.col("state").isin("pending", "delayed")).alias("queue_size")
    )


def metric_summary(samples: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Count, sum, min, max, avg and p50, p95, p99 per key; no samples give no row.

    The percentile is the value of 1-based rank floor(n * p) + 1. Equal values are counted first (combined
    map-side); the ranks are then selected by the bits of the values, for groups of any size.
    """
    rows = samples.select(F.struct(*keys, F.lit(0).alias("_all")).alias(GROUP), value.cast("double").alias("v"))
    counted = rows.filter(F.col("v").isNotNull()).groupBy(GROUP, "v").agg(F.count("*").alias("c"))
    ranks = {f"p{round(share * 100)}": F.floor(F.col("n") * F.lit(share)) + 1 for share in (0.5, 0.95, 0.99)}
    found = ranked_values(counted, ranks)
    total, extremes = F.col("sum"), ["sum", "min", "max"]
    return found.select(
        *[F.col(GROUP)[k].alias(k) for k in keys],
        F.col("n").alias("count"), *extremes, (total / F.col("n")).alias("avg"), *ranks,
    )


def latency_histogram(samples: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Cumulative buckets with sum and count for each named metric, all in one pass."""
    aggregates = []
    for name, column in metrics.items():
        v = positive(column)
        buckets = [F.count_if(v <= float(b)) for b in LATENCY_BUCKETS] + [F.count(v)]
        aggregates.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.array(*buckets).alias("buckets"),
                F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
                F.count(v).alias("count"),
            ).alias(name)
        )
    labels = F.array(*[F.lit(f"{b:g}") for b in LATENCY_BUCKETS], F.lit("+Inf"))
    rows = samples.agg(*aggregates).select(F.explode(F.array(*metrics)).alias("h"))
    return rows.select("h.metric", "h.sum", "h.count", F.explode(F.arrays_zip(labels.alias("le"), F.col("h.buckets").alias("n"))).alias("b")).select(
        "metric", F.col("b.le").alias("le"), F.col("b.n").alias("cumulative"), "sum", "count"
    )


def window_rates(
    events: DataFrame, as_of: str, started_at: str, windows: dict[str, float] = MINUTE
) -> DataFrame:
    """Submissions and completions per second per queue in each trailing window, or in the uptime if shorter; one pass for all
    windows, whose names are appended to the columns."""
    now = instant(events, "ts", as_of)
    uptime = seconds_between(now, instant(events, "ts", started_at))

    def rate(kind: str, window_s: float) -> Column:
        recent = F.col("ts") >= plus_seconds(now, F.lit(-window_s))
        seconds = F.max(F.least(F.lit(float(window_s)), uptime))
        return F.coalesce(F.try_divide(F.count_if(recent & (F.col("kind") == kind)), seconds), F.lit(0.0))

    rates = [
        rate(kind, window_s).alias(f"{column}_rate{suffix}")
        for suffix, window_s in windows.items()
        for column, kind in (("submission", "submitted"), ("throughput", "completed"))
    ]
    return events.filter(F.col("ts") <= now).groupBy("queue_name").agg(*rates)


def change_of(changes: dict[str, int]) -> Column:
    kind, change = F.col("kind"), F.lit(0)
    for k, step in changes.items():
        change = F.when(kind == k, step).otherwise(change)
    return change


def clamped_timeline(
    events: DataFrame, changes: dict[str, int], name: str, keys: list[str], chunk_s: int = HOUR_S
) -> DataFrame:
    """A level after each event that never falls below 0."""
    moves = events.filter(F.col("kind").isin(list(changes)))
    level = running_level(name, change_of(changes))
    return ordered_scan(moves, keys, ["ts", "event_id"], by_time("ts", chunk_s), [level])


# How each event moves the queue depth and the number of active tasks.
DEPTH_CHANGES = {"submitted": 1, "completed": -1, "failed": -1}
ACTIVE_CHANGES = {"started": 1, "completed": -1, "failed": -1}


def recent_errors(
    failures: DataFrame, keys: list[str], order: list[str], keep: int = ERRORS_KEPT
) -> DataFrame:
    """The newest errors per key with the stored and the displayed text."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    kept = F.substring("error", 1, ERROR_TEXT_KEPT)
    return (
        failures.withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= keep)
        .withColumns({"error": kept, "shown": shorten(kept, ERROR_TEXT_SHOWN)})
    )


def dlq_summary(dead: DataFrame, keys: list[str]) -> DataFrame:
    return dead.groupBy(*keys).agg(
        F.count("*").alias("dead_letters"),
        F.max("retry_count").alias("max_attempts"),
        F.max("dead_at").alias("latest_dead_at"),
        F.max_by("task_id", F.struct("dead_at", "task_id")).alias("latest_task"),
    )
