"""Per-task state machines with event-time timers.

State is keyed by task id, that of delayed tasks by a bucket of ids. A timer fires once the watermark has passed it, so an idle input delays it.
Rows of one task are put in event order within a step; the source's ``max_files`` bounds a step.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from taskloom.functions.times import from_micros, micros
from taskloom.operators.leases import timeout_or_default
from taskloom.schema import BACKOFF_BASE, DEFAULT_MAX_RETRIES, LEASE_EXTENSION_S
from taskloom.session import ship_package

SECOND_US = 1_000_000
#: Values that hold the delayed tasks.
BUCKETS = 8192


def _keyed(df: DataFrame, processor: StatefulProcessor, schema: str, key: str = "task_id") -> DataFrame:
    ship_package()
    return df.groupBy(key).transformWithState(processor, schema, "Append", "EventTime")


class DelayedRelease(StatefulProcessor):
    """Holds the tasks of one bucket until they are due. A task delayed again replaces the held one.

    The bucket is one value, with one timer for the earliest task: a step asks the state store a few times per bucket, not per task.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState(
            "held",
            "task_id ARRAY<STRING>, queue_name ARRAY<STRING>, priority ARRAY<INT>, due_us ARRAY<BIGINT>, at_us ARRAY<BIGINT>",
        )

    def _load(self) -> dict[str | None, tuple]:
        """(queue_name, priority, due_us, at_us) by task."""
        known = self.held.get()
        return {} if known is None else dict(zip(known[0], zip(*known[1:])))

    def _keep(self, held: dict[str | None, tuple]) -> None:
        if held:
            self.held.update((list(held), *map(list, zip(*held.values()))))
        else:
            self.held.clear()

    def _first(self, held: dict[str | None, tuple]) -> int | None:
        return min(h[2] for h in held.values()) // 1000 if held else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = {}
        for r in rows:
            known = newest.get(r.task_id)
            if known is None or (r.at_us, r.due_us) > (known[3], known[2]):
                newest[r.task_id] = (r.queue_name, r.priority, r.due_us, r.at_us)
        held = self._load()
        timer = self._first(held)
        for task_id, row in newest.items():
            if task_id not in held or held[task_id][3] <= row[3]:
                held[task_id] = row
        first = self._first(held)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self._keep(held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = {}
        for task_id, held in self._load().items():
            queue_name, priority, due_us, _ = held
            if due_us // 1000 <= now:
                yield Row(task_id=task_id, queue_name=queue_name, priority=priority, released_us=due_us, held=True)
            else:
                waiting[task_id] = held
        if waiting:
            self.handle.registerTimer(self._first(waiting))
        self._keep(waiting)

    def close(self) -> None:
        pass


def delayed_release(tasks: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Tasks at the time they become ready; ``created_at`` is the event time. Only delayed ones need state.

    They are held by hash of the task id in ``buckets`` values. A step reads and writes the buckets that its rows fall into or that
    have tasks due; one bucket, some 50 bytes for each task it holds, is in memory at a time.
    """
    rows = tasks.withWatermark("created_at", delay).select(
        "task_id",
        "queue_name",
        "priority",
        "created_at",
        micros(F.col("created_at")).alias("at_us"),
        micros(F.col("execute_after")).alias("due_us"),
    )
    is_delayed = F.coalesce(F.col("due_us") > F.col("at_us"), F.lit(False))
    at_once = rows.filter(~is_delayed).select(
        "task_id", "queue_name", "priority", F.col("at_us").alias("released_us"), F.lit(False).alias("held")
    )
    later = _keyed(
        rows.filter(is_delayed).withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets))),
        DelayedRelease(),
        "task_id STRING, queue_name STRING, priority INT, released_us BIGINT, held BOOLEAN",
        "bucket",
    )
    return at_once.unionByName(later).withColumn("released_at", from_micros(F.col("released_us"))).drop("released_us")


class LatestVersion(StatefulProcessor):
    """Holds a task's newest submission. A newer one within the horizon replaces it; else it is emitted when the horizon is over."""

    def __init__(self, horizon_us: int):
        self.horizon_us = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "us BIGINT, event_id BIGINT, queue_name STRING, priority INT, versions INT")

    def _emit(self, key, held) -> Row:
        us, event_id, queue_name, priority, versions = held
        return Row(task_id=key[0], event_id=event_id, queue_name=queue_name, priority=priority, submitted_us=us, versions=versions)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get()
        if held is not None:
            self.handle.deleteTimer(self._due_ms(held[0]))
        for row in sorted(rows, key=lambda r: (r.us, r.event_id)):
            versions = 1
            if held is not None:
                if (row.us, row.event_id) < (held[0], held[1]):
                    continue
                if row.us > held[0] + self.horizon_us:
                    yield self._emit(key, held)
                else:
                    versions = held[4] + 1
            held = (row.us, row.event_id, row.queue_name, row.priority, versions)
        self.held.update(held)
        self.handle.registerTimer(self._due_ms(held[0]))

    def _due_ms(self, us: int) -> int:
        return -(-(us + self.horizon_us) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        self.held.clear()
        yield self._emit(key, held)

    def close(self) -> None:
        pass


def latest_submission(events: DataFrame, horizon_s: int, delay: str = "1 hour") -> DataFrame:
    """The last version of each submission: repeats of a task id within the horizon of the one before replace it, and a repeat beyond
    it is a submission of its own. ``versions`` counts what was replaced, itself included. A submission whose horizon the watermark has not passed waits in the state."""
    rows = events.filter(F.col("kind") == "submitted").withWatermark("ts", delay).select(
        "task_id", "event_id", "queue_name", "priority", "ts", micros(F.col("ts")).alias("us")
    )
    schema = "task_id STRING, event_id BIGINT, queue_name STRING, priority INT, submitted_us BIGINT, versions INT"
    out = _keyed(rows, LatestVersion(horizon_s * SECOND_US), schema)
    return out.withColumn("submitted_at", from_micros(F.col("submitted_us"))).drop("submitted_us")


class RetryOrDead(StatefulProcessor):
    """Counts a task's failures: a retry with back-off below the limit, dead at it. A new submission or a
    completion starts over. The open back-offs are one value, with one timer for the earliest."""

    def __init__(self, max_retries: int, base: float):
        self.max_retries, self.base = max_retries, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures INT, due_us ARRAY<BIGINT>, n ARRAY<INT>")

    def _keep(self, failures: int, waiting: list[tuple[int, int]]) -> None:
        if failures or waiting:
            self.state.update((failures, [d for d, _ in waiting], [n for _, n in waiting]))
        else:
            self.state.clear()

    def _load(self) -> tuple[int, list[tuple[int, int]]]:
        known = self.state.get()
        return (0, []) if known is None else (known[0], list(zip(known[1], known[2])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        failures, waiting = self._load()
        timer = waiting[0][0] // 1000 if waiting else None
        for row in sorted(rows, key=lambda r: (r.us, r.event_id)):
            failures = failures + 1 if row.kind == "failed" else 0
            if failures >= max(self.max_retries, 1):
                yield Row(task_id=key[0], kind="dead", retry_count=failures, at_us=row.us)
                failures = 0
            elif failures:
                due = row.us + int(self.base**failures * SECOND_US)
                waiting.append((due, failures))
                yield Row(task_id=key[0], kind="retry", retry_count=failures, at_us=due)
        waiting.sort()
        first = waiting[0][0] // 1000 if waiting else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self._keep(failures, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        failures, waiting = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        over = [w for w in waiting if w[0] // 1000 <= now]
        waiting = waiting[len(over) :]
        for due, n in over:
            yield Row(task_id=key[0], kind="requeued", retry_count=n, at_us=due)
        if waiting:
            self.handle.registerTimer(waiting[0][0] // 1000)
        self._keep(failures, waiting)

    def close(self) -> None:
        pass


def retry_dlq(
    events: DataFrame,
    delay: str = "10 minutes",
    max_retries: int = DEFAULT_MAX_RETRIES,
    base: float = BACKOFF_BASE,
) -> DataFrame:
    """``retry`` and ``dead`` rows as failures arrive, ``requeued`` rows once a back-off is over."""
    rows = (
        events.filter(F.col("kind").isin("submitted", "completed", "failed"))
        .withWatermark("ts", delay)
        .select("task_id", "event_id", "kind", "ts", micros(F.col("ts")).alias("us"))
    )
    out = _keyed(rows, RetryOrDead(max_retries, base), "task_id STRING, kind STRING, retry_count INT, at_us BIGINT")
    return out.withColumn("at", from_micros(F.col("at_us"))).drop("at_us")


class LeaseTimeout(StatefulProcessor):
    """A start opens a lease, the owner's extensions prolong it, a finish ends it; else it expires."""

    def __init__(self, extension_us: int):
        self.extension_us = extension_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker_id STRING, opened_us BIGINT, deadline_us BIGINT")

    def _expired(self, key, lease) -> Row:
        return Row(task_id=key[0], worker_id=lease[0], lease_us=lease[1], expired_us=lease[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = lease = self.lease.get()
        for row in sorted(rows, key=lambda r: (r.us, r.event_id)):
            if lease is not None and row.us > lease[2]:
                yield self._expired(key, lease)
                lease = None
            if row.kind == "started":
                lease = (row.worker_id, row.us, row.us + row.timeout_us)
            elif row.kind != "extended":
                lease = None
            elif lease is not None and lease[0] == row.worker_id:
                lease = (lease[0], lease[1], lease[2] + self.extension_us)
        if before is not None:
            self.handle.deleteTimer(before[2] // 1000 + 1)
        if lease is None:
            self.lease.clear()
        else:
            self.lease.update(tuple(lease))
            self.handle.registerTimer(lease[2] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lease = self.lease.get()
        self.lease.clear()
        yield self._expired(key, lease)

    def close(self) -> None:
        pass


def lease_timeout(
    events: DataFrame, delay: str = "10 minutes", extension_s: float = LEASE_EXTENSION_S
) -> DataFrame:
    """Expired leases with task and worker."""
    rows = (
        events.filter(F.col("kind").isin("started", "extended", "completed", "failed"))
        .withWatermark("ts", delay)
        .select(
            "task_id",
            "event_id",
            "kind",
            "worker_id",
            "ts",
            micros(F.col("ts")).alias("us"),
            (timeout_or_default(F.col("timeout_s")) * SECOND_US).cast("long").alias("timeout_us"),
        )
    )
    out = _keyed(
        rows,
        LeaseTimeout(int(extension_s * SECOND_US)),
        "task_id STRING, worker_id STRING, lease_us BIGINT, expired_us BIGINT",
    )
    return out.select(
        "task_id",
        "worker_id",
        from_micros(F.col("lease_us")).alias("lease_time"),
        from_micros(F.col("expired_us")).alias("expired_at"),
    )
