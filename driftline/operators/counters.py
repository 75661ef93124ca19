"""Counters: deltas between an origin and a target, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter_tables(columns: DataFrame) -> DataFrame:
    """(tbl, is_counter) from a column catalog: any column typed counter."""
    return columns.groupBy("tbl").agg(F.bool_or(F.lower("type") == "counter").alias("is_counter"))


def join_target(origin: DataFrame, target: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Origin rows with the target's counters as ``t_<name>`` and ``found``."""
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in counters], F.lit(True).alias("found"))
    return origin.join(t, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def counter_delta(origin: DataFrame, target: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Deltas to add per key.  A null origin, or no change to a row that the
    target has, leaves a counter unset; rows with all unset are left out."""
    both = join_target(origin, target, keys, counters)
    deltas = []
    for c in counters:
        d = F.col(c) - F.coalesce(F.col(f"t_{c}"), F.lit(0))
        deltas.append(F.when(F.col(c).isNull() | ((d == 0) & F.col(f"t_{c}").isNotNull()), None).otherwise(d).alias(f"d_{c}"))
    out = both.select(*keys, *deltas)
    return out.where(F.coalesce(*[F.col(f"d_{c}") for c in counters]).isNotNull())


def counter_apply(target: DataFrame, deltas: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """The target after its deltas; the deltas of a retry are computed anew."""
    out = target.join(deltas, keys, "full")
    added = [F.when(F.col(c).isNotNull() | F.col(f"d_{c}").isNotNull(), F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in counters]
    return out.select(*keys, *added)
