"""Session settings the operators are designed for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A vendor or material may hold a third of the rows: split its join partitions
    # even where that costs another shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, name: str = "buylens", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_scratch: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str | None:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own; on a cluster
    there is none, and the callers stay lazy.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext.getCheckpointDir()
        folder = set_dir.rsplit("/", 1)[0] if set_dir else None
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        return None
    if not _scratch:
        _scratch.append(tempfile.TemporaryDirectory(prefix=f"buylens-{os.getpid()}-"))
    return _scratch[0].name


def splittable(aggregate):
    """An aggregate as the side of a join on its own key.

    AQE splits a hot key only between bare shuffles, not where an aggregation stands on top of one. Written out, the
    aggregate is read back as a plain side. Where there is no folder to write to, it stays as it is.
    """
    spark = aggregate.sparkSession
    return cut_lineage(aggregate) if shared_folder(spark) else aggregate


def cut_lineage(df):
    """The rows written to the shared folder and read back, used between iterations.

    Compressed columns take a fraction of the space of a checkpoint's rows, and their size is known to the joins that follow.
    Rows come back in other partitions: what depends on those has to be a column before.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{folder}/cut/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
