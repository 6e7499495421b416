"""Health thresholds over metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.text import fixed, title
from taskloom.schema import HEALTH_MAX_DEPTH, HEALTH_MAX_P95_S, HEALTH_MIN_SUCCESS

CHECKS = ["queue_depth", "success_rate", "workers", "processing_time"]


def health_columns(depth: Column, success: Column, workers: Column, p95: Column) -> dict[str, Column]:
    """Status, one verdict per check and the warning text; the bounds themselves differ between the two."""
    deep = depth > HEALTH_MAX_DEPTH
    failing = success < HEALTH_MIN_SUCCESS
    idle = (workers == 0) & (depth > 0)
    slow = F.coalesce(p95 > HEALTH_MAX_P95_S, F.lit(False))
    warnings = F.array_compact(
        F.array(
            F.when(deep, F.concat(F.lit("High queue depth: "), depth.cast("string"))),
            F.when(failing, F.concat(F.lit("Low success rate: "), fixed(success, 1), F.lit("%"))),
            F.when(idle, F.lit("No active workers with pending tasks")),
            F.when(slow, F.concat(F.lit("High p95 processing time: "), fixed(p95, 2), F.lit("s"))),
        )
    )
    fast = F.coalesce(p95 < HEALTH_MAX_P95_S, F.lit(True))
    return {
        "status": F.when(deep | failing | idle, "unhealthy").otherwise("healthy"),
        "check_queue_depth": F.when(depth < HEALTH_MAX_DEPTH, "ok").otherwise("warning"),
        "check_success_rate": F.when(success >= HEALTH_MIN_SUCCESS, "ok").otherwise("warning"),
        "check_workers": F.when((workers > 0) | (depth == 0), "ok").otherwise("critical"),
        "check_processing_time": F.when(fast, "ok").otherwise("warning"),
        "warnings": F.array_join(warnings, "; "),
    }


def health_status(metrics: DataFrame) -> DataFrame:
    """``metrics`` has queue_depth, success_rate, active_workers and p95 (null without samples)."""
    return metrics.withColumns(
        health_columns(F.col("queue_depth"), F.col("success_rate"), F.col("active_workers"), F.col("p95"))
    )


def check_titles(health: DataFrame, keys: list[str]) -> DataFrame:
    """One row per check with its display title and upper-case verdict."""
    checks = [F.struct(F.lit(c).alias("name"), F.col(f"check_{c}").alias("verdict")) for c in CHECKS]
    return health.select(*keys, F.explode(F.array(*checks)).alias("c")).select(
        *keys, title(F.col("c.name")).alias("title"), F.upper("c.verdict").alias("verdict")
    )
