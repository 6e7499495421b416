"""A task table in versions: a change writes what is new and then a manifest, whose highest number is the table.

A manifest row names a folder of tasks, partitioned by queue, and the queues of that folder that no longer count. So clearing a queue writes no task
at all, and retention rewrites only the queues that have something to drop. A reader holds the manifest it has read: during a change it sees
the old table, after it the new one, never a mixture; a change that breaks off has no manifest and no effect.
Folders of old versions take room until ``vacuum`` empties those that no kept version names.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = "folder STRING, cleared ARRAY<STRING>"


class VersionedTasks:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        """``schema`` has a ``queue_name``; a queue's name is text."""
        self.spark, self.path = spark, path.rstrip("/")
        fields = [StructField(f.name, StringType() if f.name == "queue_name" else f.dataType) for f in schema]
        self.schema = StructType(fields)

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(f"{MANIFEST}, version LONG").parquet(f"{self.path}/manifest")

    def version(self) -> int:
        return self._manifests().agg(F.max("version")).first()[0]

    def _entries(self, version: int) -> list[tuple[str, list[str]]]:
        """One entry per folder of the version."""
        return [(r.folder, r.cleared) for r in self._manifests().filter(F.col("version") == version).collect()]

    def commit(self, entries: list[tuple[str, list[str]]], version: int) -> None:
        """An existing version is never overwritten: of two writers the second fails."""
        rows = self.spark.createDataFrame(entries, MANIFEST).coalesce(1)
        rows.write.mode("error").parquet(f"{self.path}/manifest/version={version}")

    def _write(self, tasks: DataFrame) -> str:
        folder = uuid4().hex
        spread_by_queue(tasks).write.partitionBy("queue_name").parquet(f"{self.path}/data/{folder}")
        return folder

    def create(self, tasks: DataFrame) -> None:
        self.commit([(self._write(tasks), [])], 0)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, by default the newest; cleared queues are pruned with their directories."""
        tasks = None
        for folder, cleared in self._entries(self.version() if version is None else version):
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").select(*self.schema.names)
            part = part.filter(~of_queues(cleared)) if cleared else part
            tasks = part if tasks is None else tasks.unionByName(part)
        return self.spark.createDataFrame([], self.schema) if tasks is None else tasks

    def purge(self, queues: list[str]) -> None:
        """Clear queues: a manifest and nothing else."""
        version = self.version()
        self.commit([(folder, [*{*cleared, *queues}]) for folder, cleared in self._entries(version)], version + 1)

    def retain(self, kept: Callable[[DataFrame], DataFrame]) -> None:
        """Keep the rows of ``kept(table)``, which filters rows; only queues that lose some are written again.

        The names of those queues reach the driver, one string each."""
        version = self.version()
        tasks = self.read(version)
        left = kept(tasks)
        sign = lambda rows, n: rows.groupBy("queue_name").agg(F.count("*").alias("n")).select("queue_name", (F.col("n") * n).alias("n"))
        lost = sign(tasks, 1).unionByName(sign(left, -1)).groupBy("queue_name").agg(F.sum("n").alias("n"))
        shrunk = [r.queue_name for r in lost.filter("n > 0").collect()]
        if not shrunk:
            return
        folder = self._write(left.filter(of_queues(shrunk)))
        entries = [(name, [*{*cleared, *shrunk}]) for name, cleared in self._entries(version)]
        self.commit([*entries, (folder, [])], version + 1)

    def compact(self) -> None:
        """The newest version as one folder, so that what was cleared or written again is in none that it names."""
        version = self.version()
        self.commit([(self._write(self.read(version)), [])], version + 1)

    def vacuum(self, keep: int = 1) -> None:
        """Empty the folders that none of the newest ``keep`` versions names; readers of older versions must be done."""
        every = self._manifests().groupBy("folder").agg(F.max("version").alias("last"))
        newest = self.version()
        none = self.spark.createDataFrame([], StructType([f for f in self.schema if f.name != "queue_name"]))
        for row in every.filter(F.col("last") <= newest - keep).collect():
            none.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/data/{row.folder}")


def of_queues(names: list[str | None]) -> Column:
    """Whether a row is of one of the queues; tasks without a queue count as one."""
    named = F.coalesce(F.col("queue_name").isin([n for n in names if n is not None]), F.lit(False))
    return named | F.col("queue_name").isNull() if None in names else named


def spread_by_queue(tasks: DataFrame) -> DataFrame:
    """Rows of a queue together, in files of about the advisory partition size: small queues share a task, large ones are split."""
    return tasks.hint("rebalance", "queue_name")
