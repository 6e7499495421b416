"""Task tables derived from the driver's star-schema tables, so that operators run at the tables' scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions.times import instant, plus_seconds
from taskloom.operators.ordered import HOUR_S, by_time, ordered_scan, row_number

# Handler kinds by task type; MACHINERY has no handler on purpose.
HANDLERS = [
    ("AUTOMOBILE", "math"),
    ("BUILDING", "math"),
    ("HOUSEHOLD", "math"),
    ("FURNITURE", "simple"),
    ("default", "simple"),
]
OPERATIONS = ["add", "multiply", "divide", "power"]
EVENT_KINDS = {
    "signup": "submitted",
    "view": "started",
    "click": "extended",
    "purchase": "completed",
    "error": "failed",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def payload_json(key: Column, customer: Column, segment: Column) -> Column:
    data = F.concat(
        F.lit('"data":{"operation":"'),
        pick(key, OPERATIONS),
        F.lit('","a":'),
        customer.cast("string"),
        F.lit(',"b":'),
        (key % 5).cast("string"),
        F.lit("}}"),
    )
    typed = F.concat(F.lit('{"type":"'), segment, F.lit('",'), data)
    return F.when((key % 17 == 0) | segment.isNull(), F.concat(F.lit("{"), data)).otherwise(typed)


def task_columns(with_payload: bool) -> dict[str, Column]:
    key = F.col("o_orderkey")
    columns = {
        "task_id": key.cast("string"),
        "queue_name": F.concat(F.lit("q"), (F.col("o_custkey") % 4).cast("string")),
        "priority": F.substring("o_orderpriority", 1, 1).cast("int"),
        "created_at": F.col("o_orderdate"),
        "execute_after": F.when(
            key % 3 == 0, F.col("o_orderdate") + F.make_dt_interval((key % 30).cast("int"))
        ),
        "max_retries": (key % 5).cast("int"),
    }
    if with_payload:
        columns["payload"] = payload_json(key, F.col("o_custkey"), F.col("c_mktsegment"))
    return columns


def tasks(spark: SparkSession, sf_dir: str, with_payload: bool = True) -> DataFrame:
    """Task rows. The customer join is needed for the payload's type only and left out without it."""
    orders = table(spark, sf_dir, "orders")
    if with_payload:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    return orders.select(*[c.alias(n) for n, c in task_columns(with_payload).items()])


def attempts(
    spark: SparkSession, sf_dir: str, until: str | None = None, chunk_s: int = 366 * 24 * HOUR_S
) -> DataFrame:
    """One row per attempt, numbered per task. Numbers follow the start, so ``until`` can cut at the scan."""
    failed = F.col("l_returnflag") == "R"
    lines = table(spark, sf_dir, "lineitem")
    if until is not None:
        lines = lines.filter(F.col("l_shipdate") <= instant(lines, "l_shipdate", until))
    rows = lines.select(
        F.col("l_orderkey").cast("string").alias("task_id"),
        "l_shipdate",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        "l_returnflag",
    )
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    numbered = ordered_scan(rows, ["task_id"], order, by_time("l_shipdate", chunk_s), [row_number("attempt_no")])
    return numbered.select(
        "task_id",
        "attempt_no",
        F.col("l_linenumber").alias("line_no"),
        F.concat(F.lit("w"), F.col("l_suppkey").cast("string")).alias("worker_id"),
        F.col("l_shipdate").alias("started_at"),
        plus_seconds(F.col("l_shipdate"), F.col("l_quantity")).alias("finished_at"),
        F.col("l_quantity").alias("processing_s"),
        F.when(failed, "failed").otherwise("completed").alias("outcome"),
        F.when(failed, F.concat(F.lit("E"), F.col("l_linenumber").cast("string"))).alias("error"),
    )


def event_columns(df: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    return df.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("task_id"),
        F.concat(F.lit("q"), (F.col("user_id") % 4).cast("string")).alias("queue_name"),
        F.try_element_at(kind, F.col("event_type")).alias("kind"),
        F.concat(F.lit("w"), (k % 8).cast("string")).alias("worker_id"),
        F.concat(F.lit("t"), (k % 6).cast("string")).alias("task_type"),
        (k % 5).alias("priority"),
        (F.col("value") / 10).alias("processing_s"),
        (F.lit(3600) * (1 + k % 48)).alias("timeout_s"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


def handlers(spark: SparkSession) -> DataFrame:
    """An inline table, so that its size is known to the optimiser."""
    rows = ", ".join(f"('{name}', '{kind}')" for name, kind in HANDLERS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS h(task_type, handler_kind)")


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("worker_id"),
        (1 + F.col("s_suppkey") % 20).cast("int").alias("max_workers"),
        (F.col("s_acctbal") > 0).alias("running"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission documents, broken in the ways intake has to catch."""
    key = F.col("task_id").cast("long")
    priority = F.when(key % 11 == 0, -1).when(key % 11 == 1, 101).otherwise(F.col("priority"))
    retries = F.when(key % 13 == 0, 11).otherwise(F.col("max_retries"))
    due = F.when(key % 31 == 0, "soon").otherwise(F.date_format("execute_after", "yyyy-MM-dd'T'HH:mm:ss"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value.cast("string"))

    parts = F.concat_ws(
        ",",
        F.when(key % 29 != 0, field("priority", priority)),
        field("payload", F.when(key % 19 == 0, '"text"').otherwise(F.col("payload"))),
        F.when(key % 7 != 0, field("max_retries", retries)),
        field("execute_after", F.concat(F.lit('"'), due, F.lit('"'))),
    )
    doc = F.concat(F.lit("{"), parts, F.when(key % 23 == 0, "").otherwise("}"))
    return tasks(spark, sf_dir).select(F.col("task_id").alias("submission_id"), doc.alias("doc"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored task documents with optional fields left out on some rows and some cut short."""
    key = F.col("task_id").cast("long")

    def epoch(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000)

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value.cast("string"))

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    parts = F.concat_ws(
        ",",
        field("task_id", quoted(F.col("task_id"))),
        field("priority", F.col("priority")),
        field("payload", F.col("payload")),
        field("created_at", epoch("created_at").cast("decimal(20,6)")),
        F.when(key % 2 == 0, field("execute_after", epoch("execute_after").cast("decimal(20,6)"))),
        F.when(key % 2 == 1, field("retry_count", key % 4)),
        F.when(key % 7 != 0, field("max_retries", F.col("max_retries"))),
        F.when(key % 5 != 0, field("status", quoted(F.lit("completed")))),
    )
    doc = F.concat(F.lit("{"), parts, F.when(key % 23 == 0, "").otherwise("}"))
    return tasks(spark, sf_dir).select(F.col("task_id").alias("stored_key"), doc.alias("doc"))
