"""Retry and dead-letter routing, and the state of each task at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.retry import backoff_seconds, is_dead
from taskloom.functions.times import instant, plus_seconds, seconds_between
from taskloom.operators.ordered import (
    HOUR_S,
    NUMBERS,
    by_number,
    by_time,
    following,
    ordered_scan,
    running_sum,
    seen_before,
)
from taskloom.schema import BACKOFF_BASE


def attempts_known(attempts: DataFrame, as_of: str) -> DataFrame:
    """The attempt log as seen at ``as_of``: started rows only, the end unknown where it lies later."""
    now = instant(attempts, "started_at", as_of)
    done = F.col("finished_at") <= now
    return attempts.filter(F.col("started_at") <= now).withColumns(
        {
            "outcome": F.when(done, F.col("outcome")).otherwise("running"),
            "error": F.when(done, F.col("error")),
            "finished_at": F.when(done, F.col("finished_at")),
        }
    )


def retry_plan(
    attempts: DataFrame, tasks: DataFrame, base: float = BACKOFF_BASE, chunk: int = NUMBERS
) -> DataFrame:
    """What each attempt leads to: completed, retry with a back-off, dead, running, or ignored.

    Attempts after a task has been completed or has died are ignored, as the task is gone by then.
    """
    rows = attempts.join(tasks.select("task_id", "queue_name", "max_retries"), "task_id")
    failed = (F.col("outcome") == "failed").cast("long")
    completed = (F.col("outcome") == "completed").cast("long")
    counts = [running_sum("retry_count", failed), running_sum("completions", completed)]
    scanned = ordered_scan(rows, ["task_id"], ["attempt_no"], by_number("attempt_no", chunk), counts)
    failures = F.col("retry_count")
    gone = (F.col("completions") - completed > 0) | (
        failures - failed >= F.greatest(F.col("max_retries"), F.lit(1))
    )
    disposition = (
        F.when(gone, "ignored")
        .when(F.col("outcome") != "failed", F.col("outcome"))
        .when(is_dead(failures, F.col("max_retries")), "dead")
        .otherwise("retry")
    )
    retried = F.col("disposition") == "retry"
    return (
        scanned.withColumn("disposition", disposition)
        .drop("completions")
        .withColumn("backoff_s", F.when(retried, backoff_seconds(failures, base)))
        .withColumn("next_execute_after", plus_seconds(F.col("finished_at"), F.col("backoff_s")))
    )


def derive_state(
    as_of: Column,
    dead_at: Column,
    completed_at: Column,
    in_flight: Column,
    execute_after: Column,
) -> Column:
    return (
        F.when(dead_at.isNotNull(), "dead")
        .when(completed_at.isNotNull(), "completed")
        .when(in_flight, "processing")
        .when(execute_after > as_of, "delayed")
        .otherwise("pending")
    )


def task_states(
    tasks: DataFrame, attempts: DataFrame, as_of: str, chunk: int = NUMBERS
) -> DataFrame:
    """One row per task created by ``as_of`` with its state, retry count and next due time."""
    now = instant(tasks, "created_at", as_of)
    existing = tasks.filter(F.col("created_at") <= now)
    plan = retry_plan(attempts_known(attempts, as_of), existing, chunk=chunk)
    kind = F.col("disposition")
    history = plan.groupBy("task_id").agg(
        F.min(F.when(kind == "completed", F.col("finished_at"))).alias("completed_at"),
        F.min(F.when(kind == "dead", F.col("finished_at"))).alias("dead_at"),
        F.count_if(kind.isin("retry", "dead")).alias("retry_count"),
        F.max_by("next_execute_after", F.when(kind == "retry", F.col("attempt_no"))).alias("retry_after"),
        F.max_by("error", F.when(kind.isin("retry", "dead"), F.col("attempt_no"))).alias("last_error"),
        F.count_if(kind != "ignored").alias("attempts"),
        F.max(F.when(kind == "completed", F.col("processing_s"))).alias("processing_s"),
        F.max(kind == "running").alias("in_flight"),
        F.max_by("worker_id", F.when(kind == "running", F.col("attempt_no"))).alias("worker_id"),
        F.max(F.when(kind == "running", F.col("started_at"))).alias("started_at"),
    )
    due = F.coalesce(F.col("retry_after"), F.col("execute_after"))
    return existing.join(history, "task_id", "left").withColumns(
        {
            "retry_count": F.coalesce("retry_count", F.lit(0)),
            "attempts": F.coalesce("attempts", F.lit(0)),
            "execute_after": due,
            "state": derive_state(
                now, F.col("dead_at"), F.col("completed_at"), F.coalesce("in_flight", F.lit(False)), due
            ),
        }
    ).drop("retry_after", "in_flight")


def dead_letters(states: DataFrame) -> DataFrame:
    return states.filter(F.col("state") == "dead")


def current_events(events: DataFrame, as_of: str) -> DataFrame:
    """Fold an event log to the latest row per task; a plain aggregate, so a hot task is combined map-side."""
    now = instant(events, "ts", as_of)
    others = [c for c in events.columns if c != "task_id"]
    latest = F.max_by(F.struct(*others), F.struct("ts", "event_id")).alias("latest")
    return (
        events.filter(F.col("ts") <= now).groupBy("task_id").agg(latest).select("task_id", "latest.*")
    )


# A task has few events, so its chunks are wide.
TASK_CHUNK_S = 7 * 24 * HOUR_S


def transition_audit(events: DataFrame, chunk_s: int = TASK_CHUNK_S) -> DataFrame:
    """Each event with the task's state before it and a verdict on the move. An extension changes no state."""
    kind, before = F.col("kind"), F.col("state_before")
    is_open = F.coalesce(before == "started", F.lit(False))
    verdict = (
        F.when((kind == "submitted") & before.isin("submitted", "started"), "submitted_while_open")
        .when((kind == "started") & is_open, "started_twice")
        .when((kind == "extended") & ~is_open, "extended_without_lease")
        .when((kind == "completed") & (before == "completed"), "completed_twice")
        .when((kind == "failed") & (before == "completed"), "failed_after_completed")
        .when(kind.isin("completed", "failed") & ~is_open, "finished_without_start")
        .otherwise("ok")
    )
    order = ["ts", "event_id"]
    state = seen_before("state_before", F.when(kind != "extended", kind), order)
    return ordered_scan(events, ["task_id"], order, by_time("ts", chunk_s), [state]).withColumn("verdict", verdict)


def apply_completions(processing: DataFrame, completions: DataFrame) -> DataFrame:
    """The processing set, split by whether a completion arrived for the task.

    Repeated completions are combined before the exchange, so that none of them gathers in one task.
    """
    done = completions.select("task_id").distinct().withColumn("_done", F.lit(True))
    disposition = F.when(F.col("_done"), "completed").otherwise("processing")
    return processing.join(done, "task_id", "left").withColumn("disposition", disposition).drop("_done")


def event_attempts(events: DataFrame, chunk_s: int = TASK_CHUNK_S) -> DataFrame:
    """Pair each start in an event log with the task's next event, if that is a completion or a failure."""
    moves = events.filter(F.col("kind").isin("started", "completed", "failed"))
    order = ["ts", "event_id"]
    number = running_sum("attempt_no", (F.col("kind") == "started").cast("long"))
    after = following("_next", F.struct("kind", "ts"), order)
    ended = F.col("_next.kind") != "started"
    return (
        ordered_scan(moves, ["task_id"], order, by_time("ts", chunk_s), [number, after])
        .filter(F.col("kind") == "started")
        .select(
            "task_id",
            "attempt_no",
            "queue_name",
            "worker_id",
            F.col("ts").alias("started_at"),
            F.when(ended, F.col("_next.ts")).alias("finished_at"),
            F.when(ended, F.col("_next.kind")).alias("outcome"),
        )
        .withColumn("processing_s", seconds_between(F.col("finished_at"), F.col("started_at")))
    )


def attempt_durations(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Processing and wait time per attempt. Waits count from creation, and from the due time if later."""
    due = F.greatest("created_at", "execute_after")
    details = tasks.select("task_id", "queue_name", "created_at", "execute_after")
    return attempts.join(details, "task_id").withColumns(
        {
            "processing_s": seconds_between(F.col("finished_at"), F.col("started_at")),
            "wait_s": seconds_between(F.col("started_at"), F.col("created_at")),
            "wait_from_due_s": seconds_between(F.col("started_at"), due),
        }
    )


def completed_retention(states: DataFrame, as_of: str, ttl_s: float, clock: str = "created_at") -> DataFrame:
    """Rows that survive: all but tasks completed more than ``ttl_s`` ago. ``as_of`` is read as the type of the column ``clock``."""
    now = instant(states, clock, as_of)
    expired = (F.col("state") == "completed") & (plus_seconds(F.col("completed_at"), F.lit(ttl_s)) < now)
    return states.filter(~F.coalesce(expired, F.lit(False)))
