"""Readiness, priority order, backlog, admission and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.times import instant
from taskloom.operators.ordered import HOUR_S, bounded_level, by_time, ordered_scan, row_number
from taskloom.schema import DLQ_PAGE_DEFAULT, DLQ_PAGE_MAX

URGENCY = ["priority", "created_at", "task_id"]


def is_ready(execute_after: Column, now: Column) -> Column:
    """Due exactly now is ready."""
    return execute_after.isNull() | (execute_after <= now)


def ready_filter(tasks: DataFrame, as_of: str) -> DataFrame:
    now = instant(tasks, "created_at", as_of)
    return tasks.filter((F.col("created_at") <= now) & is_ready(F.col("execute_after"), now))


def delayed_filter(tasks: DataFrame, as_of: str) -> DataFrame:
    now = instant(tasks, "created_at", as_of)
    return tasks.filter((F.col("created_at") <= now) & (F.col("execute_after") > now))


def dispatch_order(ready: DataFrame, chunk_s: int = 24 * HOUR_S) -> DataFrame:
    """Position of each ready task in its queue. A chunk is a priority and a time of creation."""
    chunk = [F.col("priority"), *by_time("created_at", chunk_s)]
    return ordered_scan(ready, ["queue_name"], URGENCY, chunk, [row_number("position")])


def next_k(ready: DataFrame, k: int) -> DataFrame:
    return ready.orderBy(*URGENCY).limit(k)


def next_k_per_queue(ready: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Each map task keeps its own best k per key before the exchange (window group limit)."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*URGENCY))
    return ready.withColumn("position", position).filter(F.col("position") <= k)


def backlog_union(tasks: DataFrame, as_of: str) -> DataFrame:
    """Pending and delayed rows with their origin; the two sets split one scan."""
    now = instant(tasks, "created_at", as_of)
    origin = F.when(is_ready(F.col("execute_after"), now), "pending").otherwise("delayed")
    return tasks.filter(F.col("created_at") <= now).withColumn("origin", origin)


def promote_delayed(backlog: DataFrame, as_of: str) -> DataFrame:
    """Where each backlog row stands at ``as_of``: due delayed rows move to pending, none is lost."""
    now = instant(backlog, "created_at", as_of)
    destination = (
        F.when(F.col("origin") == "pending", "pending")
        .when(is_ready(F.col("execute_after"), now), "promoted")
        .otherwise("delayed")
    )
    return backlog.withColumn("destination", destination)


def capacity_admission(
    arrivals: DataFrame, depth: DataFrame, max_size: int, chunk_s: int = 24 * HOUR_S
) -> DataFrame:
    """Accept arrivals in order while the queue has room; ``depth`` has one row per queue."""
    order = ["created_at", "task_id"]
    numbered = ordered_scan(arrivals, ["queue_name"], order, by_time("created_at", chunk_s), [row_number("arrival")])
    current = depth.select("queue_name", F.col("queue_size").alias("depth"))
    size_then = F.coalesce("depth", F.lit(0)) + F.col("arrival")
    return (
        numbered.join(current, "queue_name", "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
        .withColumn("accepted", size_then <= max_size)
    )


def admission_log(
    events: DataFrame, max_size: int, arrival: str = "submitted", departure: str = "started", chunk_s: int = HOUR_S
) -> DataFrame:
    """Admission while tasks leave: an arrival is accepted if its queue has room then. A rejected one takes no room, a departure
    frees some (never more than there is), so the level is clamped on both sides."""
    moves = events.filter(F.col("kind").isin(arrival, departure))
    change = F.when(F.col("kind") == arrival, 1).otherwise(-1)
    rows = bounded_level(
        moves, ["queue_name"], ["ts", "event_id"], by_time("ts", chunk_s), change, F.lit(0), "depth", 0, max_size
    )
    accepted = F.when(F.col("kind") == arrival, F.col("depth_before") < max_size)
    return rows.withColumn("accepted", accepted)


def detail_lookup(ids: DataFrame, details: DataFrame) -> DataFrame:
    """Details of the listed ids; ids without details are dropped, repeated ids count once."""
    return details.join(ids.select("task_id").distinct(), "task_id", "left_semi")


def lookup_with_dlq_fallback(requested: DataFrame, live: DataFrame, dead: DataFrame) -> DataFrame:
    """Resolve ids in the live store first, then among the dead letters."""
    live = live.withColumn("_live", F.lit(True))
    dead = dead.withColumn("_dead", F.lit(True))
    columns = [c for c in live.columns if c not in ("task_id", "_live")]
    found = requested.join(live, "task_id", "left").join(
        dead.select("task_id", "_dead", *[F.col(c).alias(f"_d_{c}") for c in columns]), "task_id", "left"
    )
    source = F.when(F.col("_live"), "live").when(F.col("_dead"), "dlq").otherwise("not_found")
    picked = [F.when(F.col("_live"), F.col(c)).otherwise(F.col(f"_d_{c}")).alias(c) for c in columns]
    return found.select("task_id", source.alias("source"), *picked)


def lookup_in_states(requested: DataFrame, states: DataFrame) -> DataFrame:
    """The same answer from one table of task states, one row per task, which is read and joined once."""
    dead = F.col("state") == "dead"
    held = states.filter(dead | F.col("state").isin("pending", "delayed", "processing"))
    source = F.when(dead, "dlq").when(F.col("state").isNotNull(), "live").otherwise("not_found")
    columns = [c for c in states.columns if c != "task_id"]
    return requested.join(held, "task_id", "left").select("task_id", source.alias("source"), *columns)


def dlq_listing(dead: DataFrame, newest_first: bool = False) -> DataFrame:
    if newest_first:
        return dead.orderBy(F.col("dead_at").desc(), F.col("task_id").desc())
    return dead.orderBy("dead_at", "task_id")


def dlq_page(
    dead: DataFrame, limit: int = DLQ_PAGE_DEFAULT, offset: int = 0, newest_first: bool = False
) -> DataFrame:
    if not 1 <= limit <= DLQ_PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1..{DLQ_PAGE_MAX} and offset at least 0")
    return dlq_listing(dead, newest_first).offset(offset).limit(limit)


def purge_report(states: DataFrame) -> DataFrame:
    """How many live and dead rows a clear of each queue removes."""
    return states.groupBy("queue_name").agg(
        F.count_if(F.col("state").isin("pending", "delayed")).alias("tasks_cleared"),
        F.count_if(F.col("state") == "dead").alias("dead_letters_cleared"),
    )


def purge(states: DataFrame, queues: list[str]) -> DataFrame:
    """Rows that survive clearing the named queues."""
    return states.filter(~F.col("queue_name").isin(queues))
