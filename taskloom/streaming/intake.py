"""Stream sources over stored tables, and running a stream over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from taskloom.session import scratch_path


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int = 1000) -> DataFrame:
    """``name.parquet`` below ``folder``, one file or a folder of part files, as a stream.

    ``max_files`` bounds what one step takes in; a missing table is an error. The pattern, which only this name
    matches, lets the source list a single file as well as a folder.
    """
    folder = folder.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return stream_folder(spark, f"{folder}/[{name[0]}]{name[1:]}.parquet", schema, max_files, "*.parquet")


def stream_folder(
    spark: SparkSession, folder: str, schema, max_files: int = 1000, pattern: str = "*.parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Process all files present, appending to ``path``; a rerun with the same checkpoint takes new files only."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def run_each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_and_read(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The rows a stream appends over the files present, read back from the shared folder."""
    path = scratch_path(spark, name)
    run_to_table(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
