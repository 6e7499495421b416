"""Record layouts and the fixed values of the task model."""

from __future__ import annotations

from pyspark.sql import types as T

# Task states, limits, defaults and thresholds of the task model.
STATES = ["pending", "processing", "completed", "failed", "dead"]
DEFAULT_TASK_TYPE = "default"
DEFAULT_MAX_RETRIES = 3
MIN_PRIORITY, MAX_PRIORITY = 0, 100
MIN_RETRIES, MAX_RETRIES = 0, 10
BACKOFF_BASE = 2
LEASE_TIMEOUT_S = 300.0
LEASE_EXTENSION_S = 300.0
LEASE_NEAR_EXPIRY = 0.8
STALE_TIMEOUT_S = 300
COMPLETED_TTL_S = 3600
MAX_QUEUE_SIZE = 1000
METRIC_WINDOW_S = 300
RATE_WINDOW_S = 60
ERRORS_KEPT, ERRORS_IN_SNAPSHOT, ERRORS_ON_DASHBOARD = 100, 10, 5
ERROR_TEXT_KEPT, ERROR_TEXT_SHOWN = 500, 60
DLQ_PAGE_DEFAULT, DLQ_PAGE_MAX = 100, 1000
HEALTH_MAX_DEPTH, HEALTH_MIN_SUCCESS, HEALTH_MAX_P95_S = 1000, 95, 10
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60]
NO_HANDLER = "No handler registered for task type: "
UNKNOWN_OPERATION = "Unknown operation: "
DIVISION_BY_ZERO = "Division by zero"
PROCESSED = "Processed: "

TASK = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("queue_name", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("payload", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("execute_after", T.TimestampType()),
        T.StructField("max_retries", T.IntegerType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)
