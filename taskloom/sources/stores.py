"""Task tables on storage: one directory per queue, append-only dead letters, text export."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from taskloom.sources.versions import spread_by_queue


def read_tasks(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Read with a given schema, never an inferred one."""
    return spark.read.schema(schema).format(fmt).load(path)


def write_by_queue(tasks: DataFrame, path: str, mode: str = "append") -> None:
    """Queue directories; a filter on ``queue_name`` reads one of them only.

    A queue's rows are brought together, so it has few files, and a large queue is still written by many tasks.
    """
    spread_by_queue(tasks).write.mode(mode).partitionBy("queue_name").parquet(path)


def read_queue(spark: SparkSession, path: str, queue_name: str | None = None) -> DataFrame:
    """All queues or one of them. Queue names stay text: ``007`` is not 7."""
    found = spark.read.parquet(path).schema
    fields = [StructField(f.name, StringType() if f.name == "queue_name" else f.dataType, f.nullable) for f in found]
    tasks = spark.read.schema(StructType(fields)).parquet(path)
    return tasks if queue_name is None else tasks.filter(F.col("queue_name") == queue_name)


def namespaced(tasks: DataFrame) -> DataFrame:
    """The key of a task across queues."""
    return tasks.withColumn("namespaced_key", F.concat_ws(":", "queue_name", "task_id"))


def append_dead_letters(dead: DataFrame, path: str) -> None:
    """One directory per queue; a directory per day as well would leave many small files after a bulk load."""
    dead.write.mode("append").partitionBy("queue_name").parquet(path)


def clear_queues(spark: SparkSession, path: str, queues: list[str]) -> None:
    """Remove the directories of the named queues; others stay as they are."""
    jvm = spark._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(fs_path):
        key, _, value = status.getPath().getName().partition("=")
        if key == "queue_name" and unquote(value) in queues:
            fs.delete(status.getPath(), True)


def replace_queues(survivors: DataFrame, path: str, purged: list[str] | None = None) -> None:
    """Overwrite only the queue directories that ``survivors`` has rows for, and remove those of ``purged``."""
    if purged:
        clear_queues(survivors.sparkSession, path, purged)
    survivors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "queue_name"
    ).parquet(path)


def write_exposition(lines: DataFrame, path: str) -> None:
    """A short text page in line order, one file."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
