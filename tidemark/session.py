"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a folder under the warehouse is
    set; a cluster without one raises, as its machines would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        base = spark.conf.get("spark.sql.warehouse.dir", None) or "file:" + os.path.abspath("spark-warehouse")
        found = f"{base.rstrip('/')}/shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage is cut, and a lost
    executor costs only a re-read. The table goes when the driver's process ends. At most ``tasks``
    files are written, so that a small table doesn't become hundreds of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.staged_path = path
    remove_at_exit(path)
    return held


def remove_at_exit(path: str) -> None:
    """Removes a folder of files when the driver's process ends; in other stores the folder's own rules do."""
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, re.sub("^file:/*", "/", path), ignore_errors=True)


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int) -> None:
    """A session that keeps Spark's default number of rows in an Arrow batch gets ``rows``; any other stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for file scans the bytes of the files. No job runs."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def tasks_for(size: int, each: int = 64 << 20) -> int:
    """Tasks for a table that comes from ``size`` bytes of input, ``each`` bytes a task, 4 at least."""
    return int(min(max(4, size // each), 1 << 24))


def pow2_at_least(x: float, low: int, high: int) -> int:
    """The power of two next to ``x``, kept within ``low`` and ``high``."""
    return int(min(high, max(low, 2 ** math.ceil(math.log2(max(1.0, x))))))
