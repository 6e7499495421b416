"""Windowed metrics, health and duplicate removal on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.operators.metrics import positive, success_rate
from taskloom.schema import HEALTH_MAX_DEPTH, HEALTH_MAX_P95_S, HEALTH_MIN_SUCCESS


def rolling_metrics(
    events: DataFrame,
    delay: str = "10 minutes",
    width: str = "5 minutes",
    slide: str = "1 minute",
) -> DataFrame:
    """Sliding-window samples per task type. Rows later than ``delay`` are dropped, windows close after it."""
    value = positive(F.col("processing_s"))
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("w"), "task_type")
        .agg(
            F.count("*").alias("events"),
            F.count(value).alias("samples"),
            F.sum(value).alias("total"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
        .select("w.start", "w.end", "task_type", "events", "samples", "total", "low", "high")
    )


def stream_dedup(events: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """The first row per key; repeats within the horizon are dropped."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


def stream_health(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Health of each queue per window.

    Whether the p95 exceeds its bound needs no percentile: the value of rank floor(n * 0.95) + 1 is above
    the bound exactly when no more than floor(n * 0.95) values are at or below it.
    """
    kind, seconds = F.col("kind"), positive(F.col("processing_s"))
    done = kind == "completed"
    counted = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "queue_name")
        .agg(
            F.count_if(kind == "submitted").alias("submitted"),
            F.count_if(done).alias("completed"),
            F.count_if(kind == "failed").alias("failed"),
            F.count_if(kind == "started").alias("started"),
            F.count_if(done & (seconds > 0)).alias("_n"),
            F.count_if(done & (seconds <= HEALTH_MAX_P95_S)).alias("_within"),
            F.count_if(done & (seconds < HEALTH_MAX_P95_S)).alias("_below"),
        )
    )
    depth = F.greatest(F.lit(0), F.col("submitted") - F.col("completed") - F.col("failed"))
    rate = success_rate(F.col("completed"), F.col("failed"))
    rank = F.floor(F.col("_n") * F.lit(0.95))
    idle = (F.col("started") == 0) & (depth > 0)
    slow = (F.col("_n") > 0) & (F.col("_within") <= rank)
    fast = (F.col("_n") == 0) | (F.col("_below") > rank)
    alerts = F.array_compact(
        F.array(
            F.when(depth > HEALTH_MAX_DEPTH, "High queue depth"),
            F.when(rate < HEALTH_MIN_SUCCESS, "Low success rate"),
            F.when(idle, "No active workers with pending tasks"),
            F.when(slow, "High p95 processing time"),
        )
    )
    unhealthy = (depth > HEALTH_MAX_DEPTH) | (rate < HEALTH_MIN_SUCCESS) | idle
    return counted.select(
        F.col("w.start").alias("window_start"),
        "queue_name",
        depth.alias("queue_depth"),
        rate.alias("success_rate"),
        F.when(unhealthy, "unhealthy").otherwise("healthy").alias("status"),
        F.when(fast, "ok").otherwise("warning").alias("check_processing_time"),
        F.array_join(alerts, "; ").alias("alerts"),
    )
