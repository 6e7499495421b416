"""Rollups: partial aggregates of the event log per day, queue and type, kept as a table and merged on reading.

Counts, sums, extremes and bucket counts merge by addition and comparison, so a total is the sum over closed days and the open day's
events. The table is partitioned by day; a late event rewrites its day, from that day's events only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators.metrics import positive
from taskloom.schema import LATENCY_BUCKETS

KINDS = ["submitted", "started", "completed", "failed"]
KEYS = ["queue_name", "task_type"]


def day_of(ts: str = "ts") -> Column:
    return F.to_date(ts)


def rollup(events: DataFrame) -> DataFrame:
    """One row per day, queue and type: events by kind, and processing times as count, sum, extremes and counts per bucket (not cumulative)."""
    value = F.when(F.col("kind") == "completed", positive(F.col("processing_s")))
    edges = [float(b) for b in LATENCY_BUCKETS]
    below = [F.count_if(value <= b) for b in edges]
    inside = [below[0], *[b - a for a, b in zip(below, below[1:])], F.count(value) - below[-1]]
    return events.withColumn("day", day_of()).groupBy("day", *KEYS).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
        F.count(value).alias("samples"),
        F.sum(value).alias("total_s"),
        F.min(value).alias("low_s"),
        F.max(value).alias("high_s"),
        F.array(*inside).alias("buckets"),
    )


def write_rollups(rollups: DataFrame, path: str) -> None:
    """Replaces the days that ``rollups`` has rows for and leaves the others."""
    rows = rollups.hint("rebalance", "day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def refresh(events: DataFrame, path: str, days: list[str]) -> None:
    """Rolls the named days up again; the filter reaches the scan of the log."""
    start = [F.lit(d).cast(events.schema["ts"].dataType) for d in days]
    within = F.lit(False)
    for s in start:
        within = within | ((F.col("ts") >= s) & (F.col("ts") < s + F.expr("INTERVAL 1 DAY")))
    write_rollups(rollup(events.filter(within)), path)


def merged(spark: SparkSession, path: str, open_events: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per key of the closed days in the table and of the open day's events."""
    closed = spark.read.parquet(path)
    every = closed.unionByName(rollup(open_events).select(closed.columns))
    buckets = [F.sum(F.col("buckets")[i]).alias(f"_{i}") for i in range(len(LATENCY_BUCKETS) + 1)]
    totals = every.groupBy(*keys).agg(
        *[F.sum(k).alias(k) for k in [*KINDS, "samples"]],
        F.sum("total_s").alias("total_s"), F.min("low_s").alias("low_s"), F.max("high_s").alias("high_s"), *buckets,
    )
    running, upto = [], F.lit(0).cast("long")
    for i in range(len(LATENCY_BUCKETS) + 1):
        upto = upto + F.col(f"_{i}")
        running.append(upto)
    return totals.withColumn("cumulative", F.array(*running)).drop(*[f"_{i}" for i in range(len(LATENCY_BUCKETS) + 1)])
