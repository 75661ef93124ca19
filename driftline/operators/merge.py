"""Last-write-wins merges over keyed mutations.

A mutation is a row of key columns and ``wt`` (microseconds), ``del`` (whether
it deletes), a value and an expiry.  The newest writetime wins whatever the
order of arrival; at equal writetimes a deletion wins, then the larger value.
``max_by`` is combined before the shuffle, so a hot key costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.cells import is_expired


def newest(mutations: DataFrame, keys: list[str], value: str = "val", tie: list[str] | None = None) -> DataFrame:
    """One row per key: the winning mutation's ``value``, wt, expiry, del."""
    order = F.struct("wt", "del", *[F.col(c) for c in (tie or [value])])
    won = mutations.groupBy(*keys).agg(F.max_by(F.struct(value, "wt", "expiry", "del"), order).alias("w"))
    return won.select(*keys, *[F.col(f"w.{c}").alias(c) for c in (value, "wt", "expiry", "del")])


def visible(state: DataFrame, now: int) -> DataFrame:
    """Rows of a merged state that are neither deleted nor expired at ``now``."""
    return state.where(~F.col("del") & ~is_expired(F.col("expiry"), now))


def alive_rows(markers: DataFrame, cells: DataFrame, keys: list[str], now: int) -> DataFrame:
    """Keys whose marker, or any live cell, is visible at ``now``."""
    either = visible(markers, now).select(*keys).union(visible(cells, now).select(*keys))
    return either.distinct()


def collection_state(mutations: DataFrame, keys: list[str], element: str = "element") -> DataFrame:
    """Surviving elements of collections from ``op`` (add, remove, clear): the
    newest op per element, if an add that is newer than the latest clear."""
    cleared = mutations.where("op = 'clear'").groupBy(*keys).agg(F.max("wt").alias("cleared"))
    last = mutations.where("op <> 'clear'").groupBy(*keys, element).agg(F.max_by(F.struct("op", "wt"), F.struct("wt", F.col("op") == "remove", "seq")).alias("o"))
    joined = last.join(cleared, keys, "left").where((F.col("o.op") == "add") & (F.col("cleared").isNull() | (F.col("o.wt") > F.col("cleared"))))
    return joined.select(*keys, element, F.col("o.wt").alias("wt"))


def wide(state: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Merged (key, column, val) cells as one row per key; columns that no
    mutation named stay null."""
    return state.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("val"))).alias(c) for c in columns])


def deletes_for_nulls(rows: DataFrame, keys: list[str], columns: list[str], wt: Column) -> DataFrame:
    """Full-row writes as mutations: a null column deletes its cell."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("val")) for c in columns])).alias("c")
    return rows.select(*keys, wt.alias("wt"), each).select(*keys, "wt", "c.column", "c.val", F.col("c.val").isNull().alias("del"), F.lit(None).cast("long").alias("expiry"))


def outcomes(statements: DataFrame, row: list[str], batch: list[str]) -> DataFrame:
    """Per batch: rows, rows done, rows failed, complete.  A row is as bad as
    its worst statement (rank 0 is success)."""
    by_row = statements.groupBy(*dict.fromkeys([*batch, *row])).agg(F.max("rank").alias("worst"))
    by = by_row.groupBy(*batch).agg(F.count("*").alias("rows"), F.count_if(F.col("worst") == 0).alias("done"), F.count_if(F.col("worst") > 0).alias("failed"))
    return by.withColumn("complete", (F.col("done") == F.col("rows")) & (F.col("failed") == 0))
