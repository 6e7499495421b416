"""Reading the dynamic payload: one JSON parse per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.schema import DEFAULT_TASK_TYPE

ROUTE = "type STRING, data STRING"
MATH = "operation STRING, a DOUBLE, b DOUBLE"


def task_type(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.type"), F.lit(DEFAULT_TASK_TYPE))


def with_route(tasks: DataFrame) -> DataFrame:
    """Adds task type and data text. A payload that is no object is its own data.

    The parsed struct is a column of its own, so each payload is parsed once.
    """
    is_object = F.ltrim("payload").startswith("{")
    parsed = tasks.withColumn("_parsed", F.when(is_object, F.from_json("payload", ROUTE)))
    return parsed.withColumns(
        {
            "task_type": F.coalesce("_parsed.type", F.lit(DEFAULT_TASK_TYPE)),
            "data": F.when(is_object, F.col("_parsed.data")).otherwise(F.col("payload")),
        }
    ).drop("_parsed")
