"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

ARROW_BYTES = 8 << 20


def folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; an error where a cluster session names none."""
    shared = shared_folder(spark)
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared}/llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write a table, in folders by the column ``by`` if given, and read it back: its lineage ends and a lost executor costs nothing."""
    path = folder(df.sparkSession, what)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with small Arrow batches; Python workers of a local one find this library where the driver found it, a cluster has it installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Batches of texts that a Python worker holds at once; rows of any length fit in their own batch.
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
    return spark
