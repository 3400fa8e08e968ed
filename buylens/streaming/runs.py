"""Run a stream over everything that is there and read the result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a table as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{table}")


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file of a folder as a stream, with the schema it has."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_to_folder(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append the stream's rows to Parquet until the input is used up."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch to ``handle``; a batch that is repeated keeps its number."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
