"""Attempts of a stream: each start with the event that follows it, by a join of two streams whose state expires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attempt_pairs(starts: DataFrame, moves: DataFrame, horizon: str = "2 days", delay: str = "1 hour") -> DataFrame:
    """Each start paired with the task's next event within ``horizon``, if that is a completion or a failure.

    Both inputs are streams of the event log, with starts, or with starts, completions and failures. A start is joined to all events of
    its task that follow within the horizon; the earliest decides. Starts that nothing follows come out by the
    outer join once the watermark has passed their horizon, and then leave the state, as do the events themselves. Rows
    later than ``delay`` may be dropped. Starts whose horizon is still open at the end of the input wait in the state.
    """
    opened = starts.filter(F.col("kind") == "started").select(
        F.col("task_id").alias("start_task"), F.col("event_id").alias("start_id"), "queue_name", "worker_id",
        F.col("ts").alias("started_at"),
    ).withWatermark("started_at", delay)
    later = moves.filter(F.col("kind").isin("started", "completed", "failed")).select(
        "task_id", "event_id", "kind", "ts"
    ).withWatermark("ts", delay)
    follows = (
        (F.col("start_task") == F.col("task_id"))
        & (F.col("ts") >= F.col("started_at"))
        & (F.col("ts") <= F.col("started_at") + F.expr(f"INTERVAL {horizon}"))
        & ((F.col("ts") > F.col("started_at")) | (F.col("event_id") > F.col("start_id")))
    )
    joined = opened.join(later, follows, "left_outer")
    next_event = F.min(F.when(F.col("event_id").isNotNull(), F.struct("ts", "event_id", "kind"))).alias("next")
    decided = joined.groupBy("started_at", "start_task", "start_id", "queue_name", "worker_id").agg(next_event)
    ended = F.col("next.kind") != "started"
    finished = F.when(ended, F.col("next.ts"))
    return decided.select(
        F.col("start_task").alias("task_id"), F.col("start_id").alias("event_id"), "queue_name", "worker_id", "started_at",
        finished.alias("finished_at"),
        F.when(ended, F.col("next.kind")).alias("outcome"),
        ((F.unix_micros(finished) - F.unix_micros("started_at")) / 1e6).alias("processing_s"),
    )
