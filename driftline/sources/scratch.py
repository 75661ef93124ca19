"""Staged tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that are worth a task.  Small tables have a file for each core, and a
#: shuffle of tasks that hold few rows costs more than the rows.
TASK_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path there; its files go when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/driftline/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back, which cuts its lineage."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, path: str | None = None, **what: Column) -> tuple[DataFrame, dict]:
    """``stage``, and aggregates of the rows by name (and ``rows``, their count),
    taken while they are written.  Few rows are read back by few tasks."""
    seen = Observation()
    out = stage(df.observe(seen, F.count("*").alias("rows"), *(e.alias(k) for k, e in what.items())), name, path)
    return out.coalesce(1 + seen.get["rows"] // TASK_ROWS), seen.get


def append(df: DataFrame, path: str) -> None:
    """Add ``df`` to the Parquet files of a path from ``new_path``."""
    df.write.mode("append").parquet(path)
