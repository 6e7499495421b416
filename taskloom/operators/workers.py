"""Worker and pool statistics from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def worker_stats(workers: DataFrame, leases: DataFrame, starts: DataFrame) -> DataFrame:
    """Per worker: slots, running flag, active tasks and the task types it has handled."""
    active = leases.groupBy("worker_id").agg(F.count("*").alias("active_tasks"))
    types = starts.groupBy("worker_id").agg(
        F.array_join(F.array_sort(F.collect_set("task_type")), ",").alias("handlers")
    )
    return (
        workers.join(active, "worker_id", "left")
        .join(types, "worker_id", "left")
        .fillna(0, ["active_tasks"])
        .fillna("", ["handlers"])
    )


def pool_stats(stats: DataFrame) -> DataFrame:
    """Totals over the pool; the workers themselves stay rows of ``worker_stats``."""
    return stats.agg(
        F.count("*").alias("total_workers"),
        F.count_if("running").alias("running_workers"),
        F.coalesce(F.sum("max_workers"), F.lit(0)).alias("total_slots"),
        F.coalesce(F.sum("active_tasks"), F.lit(0)).alias("active_tasks"),
    )


def load_distribution(workers: DataFrame, completed: DataFrame) -> DataFrame:
    """Tasks processed per worker and their share, workers without any included."""
    done = completed.groupBy("worker_id").agg(F.count("*").alias("processed"))
    total = done.agg(F.sum("processed")).scalar()  # from the same groups, so the input is read once
    return (
        workers.select("worker_id")
        .join(done, "worker_id", "left")
        .fillna(0, ["processed"])
        .withColumn("share", F.coalesce(F.try_divide(F.col("processed"), total), F.lit(0.0)))
    )
