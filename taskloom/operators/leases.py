"""Lease expiry, ownership checks, conflicts and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.times import instant, plus_seconds, seconds_between
from taskloom.operators.ordered import (
    HOUR_S,
    by_number,
    by_time,
    following,
    last_seen,
    ordered_scan,
    running_sum,
    seen_before,
    sum_since,
)
from taskloom.schema import (
    LEASE_EXTENSION_S,
    LEASE_NEAR_EXPIRY,
    LEASE_TIMEOUT_S,
    STALE_TIMEOUT_S,
)


def timeout_or_default(timeout: Column, default: float = LEASE_TIMEOUT_S) -> Column:
    """Zero and null both mean the default."""
    return F.coalesce(F.nullif(timeout.cast("double"), F.lit(0.0)), F.lit(default))


def deadline(lease_time: Column, timeout: Column) -> Column:
    return plus_seconds(lease_time, timeout_or_default(timeout))


def is_expired(lease_time: Column, timeout: Column, now: Column) -> Column:
    """Strictly after the deadline."""
    return now > deadline(lease_time, timeout)


def open_leases(events: DataFrame, as_of: str) -> DataFrame:
    """Tasks whose last start, completion or failure up to ``as_of`` is a start."""
    now = instant(events, "ts", as_of)
    last = F.max_by(
        F.struct("kind", "worker_id", "queue_name", F.col("ts").alias("lease_time"), "timeout_s"),
        F.struct("ts", "event_id"),
    )
    moves = events.filter((F.col("ts") <= now) & F.col("kind").isin("started", "completed", "failed"))
    return (
        moves.groupBy("task_id")
        .agg(last.alias("last"))
        .filter(F.col("last.kind") == "started")
        .select("task_id", "last.worker_id", "last.queue_name", "last.lease_time", "last.timeout_s")
    )


def with_expiry(leases: DataFrame, as_of: str) -> DataFrame:
    """Deadline, seconds left (floor 0) and expiry of each lease."""
    now = instant(leases, "lease_time", as_of)
    end = deadline(F.col("lease_time"), F.col("timeout_s"))
    return leases.withColumns(
        {
            "deadline": end,
            "remaining_s": F.greatest(F.lit(0.0), seconds_between(end, now)),
            "expired": now > end,
            "age_s": seconds_between(now, F.col("lease_time")),
        }
    )


def lease_expired_filter(leases: DataFrame, as_of: str) -> DataFrame:
    now = instant(leases, "lease_time", as_of)
    return leases.filter(is_expired(F.col("lease_time"), F.col("timeout_s"), now))


def lease_near_expiry(leases: DataFrame, as_of: str, share: float = LEASE_NEAR_EXPIRY) -> DataFrame:
    """Tasks that have used more than ``share`` of their time and need an extension."""
    limit = timeout_or_default(F.col("timeout_s")) * share
    return with_expiry(leases, as_of).filter(F.col("age_s") > limit)


def stale_filter(
    states: DataFrame, as_of: str, timeout_s: float = STALE_TIMEOUT_S, age_from: str = "created_at"
) -> DataFrame:
    """Tasks in processing for more than ``timeout_s`` seconds, put back to pending."""
    now = instant(states, age_from, as_of)
    age = seconds_between(now, F.col(age_from))
    return (
        states.filter((F.col("state") == "processing") & (age > timeout_s))
        .withColumn("age_s", age)
        .withColumn("state", F.lit("pending"))
    )


def lease_action_check(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """Outcome of release and extend requests against the lease table."""
    held = leases.select("task_id", F.col("worker_id").alias("holder"))
    outcome = (
        F.when(F.col("holder").isNull(), "not_found")
        .when(F.col("holder") != F.col("worker_id"), "wrong_worker")
        .otherwise("ok")
    )
    return requests.join(held, "task_id", "left").withColumn("outcome", outcome)


def lease_conflicts(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """Acquire requests: free, held by an unexpired lease, or overriding an expired one."""
    held = leases.select("task_id", F.col("worker_id").alias("holder"), "lease_time", "timeout_s")
    outcome = (
        F.when(F.col("holder").isNull(), "acquired")
        .when(is_expired(F.col("lease_time"), F.col("timeout_s"), F.col("ts")), "override_expired")
        .otherwise("conflict")
    )
    requests = requests.drop("timeout_s")
    return requests.join(held, "task_id", "left").withColumn("outcome", outcome)


def visible_tasks(ready: DataFrame, leases: DataFrame, as_of: str) -> DataFrame:
    """Ready tasks that no unexpired lease hides."""
    now = instant(leases, "lease_time", as_of)
    active = leases.filter(~is_expired(F.col("lease_time"), F.col("timeout_s"), now))
    return ready.join(active.select("task_id").distinct(), "task_id", "left_anti")


def requeue_expired(leases: DataFrame, as_of: str) -> DataFrame:
    """Leased tasks: back to pending once expired, else still processing."""
    now = instant(leases, "lease_time", as_of)
    expired = is_expired(F.col("lease_time"), F.col("timeout_s"), now)
    return leases.withColumn("state", F.when(expired, "pending").otherwise("processing"))


def lease_stats(leases: DataFrame, as_of: str) -> DataFrame:
    """Active (expired ones included), expired, and the age of unexpired leases; 0 where there is none."""
    live_age = F.when(~F.col("expired"), F.col("age_s"))
    return with_expiry(leases, as_of).agg(
        F.count("*").alias("active_leases"),
        F.count_if("expired").alias("expired_leases"),
        F.coalesce(F.avg(live_age), F.lit(0.0)).alias("avg_lease_s"),
        F.coalesce(F.max(live_age), F.lit(0.0)).alias("max_lease_s"),
    )


def lease_sessions(
    events: DataFrame, as_of: str, extension_s: float = LEASE_EXTENSION_S, chunk_s: int = 7 * 24 * HOUR_S
) -> DataFrame:
    """One row per lease: a start opens it, the owner's extensions push the deadline, a finish or the next
    start ends it. The effective deadline is the first one that passed before the next event, if any did."""
    now = instant(events, "ts", as_of)
    log = events.filter(
        (F.col("ts") <= now) & F.col("kind").isin("started", "extended", "completed", "failed")
    )
    started = F.col("kind") == "started"
    order, chunk = ["ts", "event_id"], by_time("ts", chunk_s)
    opening = {
        "owner": F.col("worker_id"),
        "opened_at": F.col("ts"),
        "allowed_s": timeout_or_default(F.col("timeout_s")),
    }
    measures = [last_seen(n, F.when(started, c), order) for n, c in opening.items()]
    measures.append(running_sum("lease_no", started.cast("long")))
    measures.append(seen_before("move_before", F.when(F.col("kind") != "extended", F.col("kind")), order))
    rows = ordered_scan(log, ["task_id"], order, chunk, measures).filter(F.col("lease_no") > 0)
    is_open = started | (F.col("move_before") == "started")
    extends = (F.col("kind") == "extended") & is_open & (F.col("worker_id") == F.col("owner"))
    rows = rows.withColumns({"is_open": is_open, "extends": F.coalesce(extends, F.lit(False)).cast("long")})
    granted = sum_since("granted", F.col("extends"), started, order)
    rows = ordered_scan(rows, ["task_id"], order, chunk, [granted])
    before = F.col("granted") - F.col("extends")
    deadline_then = plus_seconds(F.col("opened_at"), F.col("allowed_s") + before * extension_s)
    rows = rows.withColumn("deadline_then", deadline_then)
    passed = F.col("is_open") & (F.col("kind") != "started") & (F.col("ts") > F.col("deadline_then"))
    leases = rows.groupBy("task_id", "lease_no").agg(
        F.max("opened_at").alias("lease_time"),
        F.max("owner").alias("worker_id"),
        F.max("allowed_s").alias("allowed_s"),
        F.sum("extends").alias("extensions"),
        F.min(F.when(passed, F.col("deadline_then"))).alias("missed"),
        F.min(F.when(F.col("is_open") & (F.col("kind").isin("completed", "failed")), F.col("ts"))).alias(
            "finished_at"
        ),
    )
    next_open = following("next_open", F.col("lease_time"), ["lease_no"])
    chain = ordered_scan(leases, ["task_id"], ["lease_no"], by_number("lease_no"), [next_open])
    last_deadline = plus_seconds(
        F.col("lease_time"), F.col("allowed_s") + F.col("extensions") * extension_s
    )
    ended = F.coalesce("finished_at", "next_open")
    expired_at = F.coalesce(
        F.col("missed"), F.when(F.coalesce(ended, now) > last_deadline, last_deadline)
    )
    return chain.select(
        "task_id",
        "lease_no",
        "worker_id",
        "lease_time",
        "extensions",
        F.coalesce(F.col("missed"), last_deadline).alias("deadline"),
        ended.alias("ended_at"),
        expired_at.alias("expired_at"),
    )


def lease_counters(sessions: DataFrame) -> DataFrame:
    """Active gauge, expirations and extensions over all leases of a log."""
    return sessions.agg(
        F.count_if(F.col("ended_at").isNull() & F.col("expired_at").isNull()).alias("active_leases"),
        F.count_if(F.col("expired_at").isNotNull()).alias("lease_expirations_total"),
        F.coalesce(F.sum("extensions"), F.lit(0)).alias("lease_extensions_total"),
    )
