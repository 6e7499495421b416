"""Rate audit and pacing: successive starts of a queue are at least 1/rate apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions.times import from_micros, instant, micros, seconds_between
from taskloom.operators.ordered import HOUR_S, by_time, ordered_scan, paced, previous


def rate_limit_audit(starts: DataFrame, rate: float, chunk_s: int = HOUR_S) -> DataFrame:
    """Gap of each start to the queue's previous one; the first start is free."""
    order = ["ts", "event_id"]
    before = previous("previous_ts", F.col("ts"), order)
    rows = ordered_scan(starts, ["queue_name"], order, by_time("ts", chunk_s), [before])
    gap = seconds_between(F.col("ts"), F.col("previous_ts"))
    return rows.withColumns(
        {"gap_s": gap, "too_early": F.coalesce(gap < 1.0 / rate, F.lit(False))}
    )


def rate_limited_schedule(
    ready: DataFrame, as_of: str, rate: int, ready_column: str = "ready_at", chunk_s: int = 24 * HOUR_S
) -> DataFrame:
    """Earliest release per queue: ``d_i = max(ready_i, d_{i-1} + 1/rate)``.

    Unrolled, that is ``i/rate + max over j <= i of (ready_j - j/rate)``: a running maximum. It is kept in
    whole micros times the rate, measured from ``as_of``, so no precision is lost.
    """
    anchor = micros(instant(ready, ready_column, as_of))
    steps = paced("release_no", "offset", (micros(F.col(ready_column)) - anchor) * rate, 1_000_000)
    rows = ordered_scan(ready, ["queue_name"], [ready_column, "priority", "task_id"], by_time(ready_column, chunk_s), [steps])
    delay = F.col("offset") + F.col("release_no") * 1_000_000
    # Whole micros, rounded up: never earlier than permitted. Integer division, as a double is too short.
    whole = F.call_function("div", delay, F.lit(rate))
    release_us = anchor + whole + F.when(delay % rate > 0, 1).otherwise(0)
    return rows.withColumn("release_at", from_micros(release_us)).drop("offset")
