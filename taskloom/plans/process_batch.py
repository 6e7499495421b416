"""The worker path over a whole task table: ready, route, handle, then completed, retry or dead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions.payload import with_route
from taskloom.functions.retry import backoff_seconds, is_dead
from taskloom.functions.times import instant, plus_seconds
from taskloom.operators.dispatch import ready_filter
from taskloom.operators.handlers import (
    Handlers,
    apply_handlers,
    default_handlers,
    handler_route_join,
)
from taskloom.schema import BACKOFF_BASE


def process_batch(
    tasks: DataFrame,
    registry: DataFrame,
    as_of: str,
    handlers: Handlers | None = None,
    base: float = BACKOFF_BASE,
) -> DataFrame:
    """Outcome of one attempt at every ready task. Narrow but for the registry join."""
    now = instant(tasks, "created_at", as_of)
    if "retry_count" not in tasks.columns:
        tasks = tasks.withColumn("retry_count", F.lit(0))
    routed = handler_route_join(with_route(ready_filter(tasks, as_of)), registry)
    handled = apply_handlers(routed, handlers or default_handlers())
    failures = F.col("retry_count") + F.col("error").isNotNull().cast("int")
    outcome = (
        F.when(F.col("error").isNull(), "completed")
        .when(is_dead(failures, F.col("max_retries")), "dead")
        .otherwise("retry")
    )
    due = plus_seconds(now, backoff_seconds(F.col("retry_count"), base))
    return (
        handled.withColumns({"retry_count": failures, "outcome": outcome})
        .withColumn("next_execute_after", F.when(F.col("outcome") == "retry", due))
        .select(
            "task_id",
            "queue_name",
            "task_type",
            "outcome",
            "result",
            "error",
            "retry_count",
            "next_execute_after",
        )
    )
