"""JSON intake and storage form of tasks: validation, encoding, decoding, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.times import seconds
from taskloom.schema import (
    DEFAULT_MAX_RETRIES,
    MAX_PRIORITY,
    MAX_RETRIES,
    MIN_PRIORITY,
    MIN_RETRIES,
    STATES,
)

STORED = (
    "task_id STRING, priority INT, payload STRING, created_at DOUBLE, execute_after DOUBLE, "
    "retry_count INT, max_retries INT, status STRING, _corrupt STRING"
)


SUBMITTED = "priority STRING, payload VARIANT, max_retries STRING, execute_after STRING, _corrupt STRING"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _whole_number(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def submit_validate(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Parse submissions, fill defaults and give the first broken rule as ``reason``; no row is dropped.

    Each step is a projection of its own, so a document is parsed once.
    """
    parsed = docs.withColumn("_s", F.from_json(F.col(column), SUBMITTED, PERMISSIVE))
    retries, due = F.col("_s.max_retries"), F.col("_s.execute_after")
    typed = parsed.withColumns(
        {
            "priority": _whole_number(F.col("_s.priority")),
            "max_retries": F.when(retries.isNull(), DEFAULT_MAX_RETRIES).otherwise(_whole_number(retries)),
            "execute_after": F.coalesce(
                F.timestamp_seconds(due.try_cast("double")).cast("timestamp_ntz"), due.try_cast("timestamp_ntz")
            ),
            "payload": F.to_json("_s.payload"),
        }
    )
    broken = {
        "malformed": F.col("_s").isNull() | F.col("_s._corrupt").isNotNull(),
        "priority": ~F.coalesce(F.col("priority").between(MIN_PRIORITY, MAX_PRIORITY), F.lit(False)),
        "payload": ~F.coalesce(F.col("payload").startswith("{"), F.lit(False)),
        "max_retries": ~F.coalesce(F.col("max_retries").between(MIN_RETRIES, MAX_RETRIES), F.lit(False)),
        "execute_after": due.isNotNull() & F.col("execute_after").isNull(),
    }
    reason = F.coalesce(*[F.when(rule, name) for name, rule in broken.items()])
    checked = typed.withColumn("reason", reason)
    return checked.withColumns(
        {
            "accepted": F.col("reason").isNull(),
            "payload": F.when(F.col("payload").startswith("{"), F.col("payload")),
        }
    ).drop("_s")


def task_encode(tasks: DataFrame) -> DataFrame:
    """One JSON document per task with the payload nested in it."""

    def epoch(name: str) -> Column:
        return seconds(F.col(name)).cast("decimal(20,6)").alias(name)

    fields = F.struct(
        "task_id",
        "priority",
        F.try_parse_json("payload").alias("payload"),
        epoch("created_at"),
        epoch("execute_after"),
        "retry_count",
        "max_retries",
        "status",
    )
    return tasks.select("task_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("doc"))


def task_decode(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Stored documents to task columns with defaults; broken ones are flagged ``quarantined``."""
    parsed = docs.withColumn("_t", F.from_json(F.col(column), STORED, PERMISSIVE))

    def moment(name: str) -> Column:
        return F.timestamp_micros(F.round(F.col(f"_t.{name}") * 1e6).cast("long")).cast("timestamp_ntz")

    status = F.coalesce("_t.status", F.lit("pending"))
    required = ["task_id", "priority", "created_at"]
    # The payload's key must be there; its value may be null.
    no_payload = ~F.coalesce(F.array_contains(F.json_object_keys(column), "payload"), F.lit(False))
    broken = F.col("_t").isNull() | F.col("_t._corrupt").isNotNull() | ~status.isin(STATES) | no_payload
    for name in required:
        broken |= F.col(f"_t.{name}").isNull()
    fields = {
        "task_id": F.col("_t.task_id"),
        "priority": F.col("_t.priority"),
        "payload": F.col("_t.payload"),
        "created_at": moment("created_at"),
        "execute_after": moment("execute_after"),
        "retry_count": F.coalesce("_t.retry_count", F.lit(0)),
        "max_retries": F.coalesce("_t.max_retries", F.lit(DEFAULT_MAX_RETRIES)),
        "status": status,
    }
    keep = [c for c in docs.columns if c != column and c not in fields]
    return parsed.withColumn("quarantined", broken).select(
        *keep,
        "quarantined",
        *[F.when(~F.col("quarantined"), value).alias(name) for name, value in fields.items()],
        F.when(F.col("quarantined"), F.col(column)).alias("raw"),
    )


def task_defaults(tasks: DataFrame) -> DataFrame:
    """Fill id, creation time and retry fields at intake; write the result once, as ids are random."""
    return tasks.withColumns(
        {
            "task_id": F.coalesce("task_id", F.uuid()),
            "created_at": F.coalesce("created_at", F.current_timestamp().cast("timestamp_ntz")),
            "retry_count": F.coalesce("retry_count", F.lit(0)),
            "max_retries": F.coalesce("max_retries", F.lit(DEFAULT_MAX_RETRIES)),
            "status": F.coalesce("status", F.lit("pending")),
        }
    )
