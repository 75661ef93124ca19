"""Sources and sinks of keyed tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.catalog import clustered


def read_typed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A snapshot with typed columns in schema order, or those asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_envelopes(spark: SparkSession, path: str, json: str = "json") -> DataFrame:
    """A snapshot of JSON envelopes; decode() takes it from here."""
    return spark.read.parquet(path).where(F.col(json).isNotNull())


def write_typed(df: DataFrame, path: str, order: list[str], batch_us: int, partition: list[str] | None = None, clustering: dict[str, str] | None = None) -> None:
    """Write all columns in the target's order, nulls included, at the batch's
    time; rows are clustered within partitions of the key.  A batch has a
    folder of its own, which it writes anew when it runs again."""
    rows = df.select(*order)
    if partition:
        rows = clustered(rows, partition, clustering or {})
    rows.write.mode("overwrite").parquet(f"{path}/wt={batch_us}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches that ``write_typed`` wrote, with their time ``wt``."""
    return spark.read.option("basePath", path).parquet(f"{path}/wt=*")


def row_count(table: DataFrame | None) -> DataFrame:
    """One row: ``rows``, or -1 for a table whose count is unknown (None)."""
    return SparkSession.active().range(1).select(F.lit(-1).cast("long").alias("rows")) if table is None else table.agg(F.count("*").alias("rows"))


def has_data(read) -> bool:
    """Whether ``read()`` gives a table with any row.  A failure of reading
    counts as data, so that nothing is dropped by mistake."""
    try:
        return not read().limit(1).isEmpty()
    except (PySparkException, Py4JJavaError):
        return True


def dry_run(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """How many rows a write would have written, per group if asked."""
    return df.groupBy(*by).agg(F.count("*").alias("would_write"))


def reload(df: DataFrame, path: str, started: bool) -> None:
    """Drop the target and write it again, only if the copy has not started."""
    if started:
        raise ValueError("the copy has started; its target is not dropped")
    df.write.mode("overwrite").parquet(path)
