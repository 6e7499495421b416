"""Per-batch sinks. Each writes to a place named by the batch id, so a repeated batch has no second effect."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taskloom.operators.dispatch import URGENCY
from taskloom.streaming.intake import run_each_batch

BatchStep = Callable[[DataFrame, int], None]


def idempotent_sink(path: str) -> BatchStep:
    """At-least-once delivery, effect once: a batch overwrites its own directory."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return step


class ManifestTable:
    """A table that batches are added to, each as a whole or not at all.

    A batch's rows go to a folder of their own; one manifest row, written last under the batch's id, makes them part of the table. What
    a broken step has written has no manifest row and is never read; a batch that has one is not written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, path: str, schema) -> DataFrame:
        """The rows there, none if the folder is not there yet."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._read(f"{self.path}/manifest", "batch_id LONG, folder STRING")

    def add(self, rows: DataFrame, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
        if not self.manifest().filter(F.col("batch_id") == batch_id).isEmpty():
            return
        folder = f"batch-{batch_id}-{uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/data/{folder}")
        self.commit(batch_id, folder)

    def commit(self, batch_id: int, folder: str) -> None:
        entry = self.spark.range(1).select(F.lit(folder).alias("folder"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch_id={batch_id}")

    def read(self, schema: str | StructType) -> DataFrame:
        """The rows of all batches that are in the manifest: one folder name per batch is listed."""
        folders = [f"{self.path}/data/{r.folder}" for r in self.manifest().select("folder").collect()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return read.parquet(*folders)


def dead_letter_sink(path: str) -> BatchStep:
    """Dead letters of a stream: a repeated or half-written batch has one effect."""

    def step(batch: DataFrame, batch_id: int) -> None:
        ManifestTable(batch.sparkSession, path).add(batch, batch_id)

    return step


class Backlog:
    """Waiting tasks as a log: immutable runs of arrivals by priority, and markers of what was taken.

    Step n writes its arrivals and its takes, and reads what earlier steps left: the run of the last compaction and all after it. Counts of arrivals
    and takes per priority tell how far down the priorities a step must look, so it reads those directories only. Every
    ``compact_every`` steps what still waits is written as one run, so no step reads more than that many runs beside it. All
    places are named by the step, and a step reads only what earlier ones wrote, so repeating it writes the same.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, compact_every: int = 16):
        self.spark, self.path, self.schema, self.every = spark, path.rstrip("/"), schema, compact_every

    def _base(self, step: int) -> int | None:
        """The step after which the last run before ``step`` was compacted."""
        last = (step // self.every) * self.every - 1
        return last if last >= 0 else None

    def _read(self, kind: str, steps: range) -> DataFrame:
        none = self.spark.createDataFrame([], self.schema)
        if not steps:
            return none
        read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{kind}")
        return read.parquet(*[f"{self.path}/{kind}/step={n}" for n in steps]).select(*none.columns)

    def _runs(self, kind: str, step: int) -> DataFrame:
        base = self._base(step)
        runs = self._read(kind, range(0 if base is None else base + 1, step))
        if kind == "arrived" and base is not None:
            runs = runs.unionByName(self._read("compacted", range(base, base + 1)))
        return runs

    def _write(self, rows: DataFrame, kind: str, step: int) -> None:
        rows.write.mode("overwrite").partitionBy("priority").parquet(f"{self.path}/{kind}/step={step}")

    def waiting(self, step: int) -> DataFrame:
        """What waits before ``step``."""
        taken = self._runs("taken", step).select("task_id")
        return self._runs("arrived", step).join(taken, "task_id", "left_anti")

    def taken(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/taken")

    def advance(self, batch: DataFrame, step: int, k: int) -> None:
        """Adds the arrivals of a step and takes the k most urgent of all that wait."""
        self._write(batch, "arrived", step)
        arrived = self._runs("arrived", step).unionByName(self._read("arrived", range(step, step + 1)))
        counts = arrived.groupBy("priority").count().unionByName(
            self._runs("taken", step).groupBy("priority").agg((-F.count("*")).alias("count"))
        )
        # One row per priority: the last one that is needed for k tasks.
        ahead = F.sum("left").over(Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, -1))
        left = counts.groupBy("priority").agg(F.sum("count").alias("left")).filter("left > 0")
        last = left.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("ahead") < k).agg(F.max("priority")).first()[0]
        urgent = F.lit(False) if last is None else F.col("priority") <= last
        taken = self._runs("taken", step).filter(urgent).select("task_id")
        chosen = arrived.filter(urgent).join(taken, "task_id", "left_anti").orderBy(*URGENCY).limit(k)
        self._write(chosen, "taken", step)
        if (step + 1) % self.every == 0:
            gone = self._read("taken", range(step, step + 1)).unionByName(self._runs("taken", step)).select("task_id")
            self._write(arrived.join(gone, "task_id", "left_anti"), "compacted", step)


def priority_sink(path: str, k: int, schema: str, compact_every: int = 16) -> BatchStep:
    """Take the k most urgent of the batch and of all that still waits."""

    def step(batch: DataFrame, batch_id: int) -> None:
        Backlog(batch.sparkSession, path, schema, compact_every).advance(batch, batch_id, k)

    return step


def run_with_callback(stream: DataFrame, callback: BatchStep, checkpoint: str) -> None:
    """Hand each batch of rows (for instance expired leases) to the user's function."""
    run_each_batch(stream, callback, checkpoint)
