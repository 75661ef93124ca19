"""Ranges of a table, their pages, and where a copy may resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.sources.scratch import stage


def range_ids(table: DataFrame, column: str = "range_id") -> DataFrame:
    """Range ids that are neither null nor empty."""
    return table.select(column).where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).distinct()


def required_ranges(table: DataFrame, column: str = "range_id") -> DataFrame:
    """As ``range_ids``; raises if there are none, because a copy of no ranges
    would otherwise count as complete."""
    ids = range_ids(table, column)
    if ids.isEmpty():
        raise ValueError("the source has no ranges to copy")
    return ids


def scan_range(spark: SparkSession, path: str, value, column: str = "range_id") -> DataFrame:
    """One range of a table that is laid out by range: other ranges' folders
    are pruned and not read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))


#: Member of a position that tells it from the start.
BEGUN = "_begun"


def page(table: DataFrame, after: dict, size: int) -> DataFrame:
    """The next ``size`` rows behind a position, in order (nulls first), each
    with ``next``: the position behind it, where the next page goes on.  A
    position has a value, which may be null, for each column of a key that
    tells rows apart; one of nulls alone is the start, unless it is a ``next``.
    Rows that the key does not tell apart may be lost at a page's end: for
    those see ``paged``."""
    order = [c for c in after if c != BEGUN]
    behind, equal = F.lit(False), F.lit(True)
    for c in order:
        v = after[c]
        behind = behind | (equal & (F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))))
        equal = equal & F.col(c).eqNullSafe(F.lit(v))
    start = not after.get(BEGUN) and all(after[c] is None for c in order)
    rows = table if start else table.where(behind)
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(size).withColumn("next", F.struct(*order, F.lit(True).alias(BEGUN)))


def ranked(table: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``table`` with ``rank``, each row's place in the order (nulls first),
    from 0.  Rows are dealt to tasks by ranges of the order and sorted there;
    a task's ranks start behind the counts of the tasks before it, so that no
    task sees all rows.  The table is staged, so rows that are alike keep their
    places."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = table.repartitionByRange(parts, *keys) if parts else table.repartitionByRange(*keys)
    dealt = stage(dealt.sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    # a row per task
    counts = dealt.groupBy(part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_many"))
    before = F.coalesce(F.sum("_many").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", "_first", before.alias("_before"))
    return dealt.join(F.broadcast(counts), part == F.col("_part")).withColumn("rank", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_part", "_first", "_before")


def paged(table: DataFrame, order: list[str], size: int, parts: int | None = None) -> DataFrame:
    """``table`` with ``rank`` and ``page``: any page is found by its number,
    and all together have each row once, nulls and repeats included."""
    return ranked(table, order, parts).withColumn("page", F.floor(F.col("rank") / size).cast("long"))


def balanced(table: DataFrame, order: list[str], target: int, parts: int | None = None) -> DataFrame:
    """Split points of ranges of ``target`` rows: range, first, last (structs
    of the order's columns) and rows.  Ranges are cut by rank, so a hot stretch
    is split and thin ones are packed; they differ by their last one only."""
    by = paged(table.select(*order), order, target, parts)
    return by.groupBy(F.col("page").alias("range")).agg(F.min_by(F.struct(*order), "rank").alias("first"), F.max_by(F.struct(*order), "rank").alias("last"), F.count("*").alias("rows"))


#: Most entries of a page of a log.
PAGE_MOST = 10_000


def log_page(log: DataFrame, order: list[str], skip: int, take: int) -> DataFrame:
    """Entries ``skip`` to ``skip + take`` in a stable order; a page has 1 to
    ``PAGE_MOST`` entries, whatever is asked for."""
    return log.orderBy(*order).offset(max(0, skip)).limit(min(max(1, take), PAGE_MOST))


def union_ranges(stored: DataFrame, source: DataFrame, key: str = "range_id") -> DataFrame:
    """Stored ranges, which are never dropped, and new ones of the source."""
    new = new_ranges(stored, source, key).withColumn("done", F.lit(False))
    return stored.select(key, "done").unionByName(new)


def new_ranges(stored: DataFrame, source: DataFrame, key: str = "range_id") -> DataFrame:
    return source.select(key).distinct().join(stored.select(key), key, "left_anti")


def pending_ranges(ranges: DataFrame, online: bool, key: str = "range_id") -> DataFrame:
    """Ranges to work on and their phase; online, completed ones are replayed."""
    phase = F.when(F.col("done"), "Replay").otherwise("Bulk")
    return ranges.where(F.lit(online) | ~F.col("done")).select(key, phase.alias("phase"))


def safe_resume_point(pages: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """The position to read from that skips no unwritten page: the first page
    not done, else one past the last.  What is unknown is not done."""
    first = F.min(F.when(~F.coalesce("done", F.lit(False)), F.col(seq)))
    return pages.groupBy(*by).agg(F.coalesce(first, F.max(seq) + 1).alias("next_seq"))


def untrimmed(pages: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """Pages without each range's completed prefix.  The first page not done
    comes from an aggregate, so that no range is sorted whole."""
    first = pages.where(~F.coalesce("done", F.lit(False))).groupBy(*by).agg(F.min(seq).alias("_first"))
    return pages.join(first, by).where(F.col(seq) >= F.col("_first")).drop("_first")


def range_progress(pages: DataFrame, table: list[str], range_id: str = "range_id") -> DataFrame:
    """Complete ranges of all, and whether the table is drained."""
    by = pages.groupBy(*table, range_id).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("done"))
    out = by.groupBy(*table).agg(F.count_if("done").alias("complete"), F.count("*").alias("ranges"))
    return out.withColumn("drained", F.col("complete") >= F.col("ranges"))


def head_and_tail(log: DataFrame, order: list[str], head: int, tail: int) -> DataFrame:
    """The first and last entries in order; both ends are top-k, not a sort.
    Where they overlap, in a log of fewer entries than both, each stays once,
    also of entries that are alike."""
    many = log.count()
    first = log.orderBy(*order).limit(head)
    last = log.orderBy(*[F.col(c).desc() for c in order]).limit(max(0, min(tail, many - head)))
    return first.union(last)


def failure_runs(log: DataFrame, key: list[str], order: str, failed: str, threshold: int, span: int = 50_000) -> DataFrame:
    """Per key the longest run of failures without a success, and whether it
    reaches the threshold.

    A key's entries are cut into spans of the (numeric) order, so that many
    tasks sort a key.  A span is summed up by its longest run, the run that it
    begins and the run that it ends with; spans are then joined in order.
    """
    part = Window.partitionBy(*key, "_span").orderBy(order)
    slim = log.select(*key, order, F.col(failed).alias("_failed"), F.floor(F.col(order) / span).alias("_span"))
    # each success opens a run; run 0 is what stands before the first
    runs = slim.withColumn("_run", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(part)).groupBy(*key, "_span", "_run").agg(F.count_if("_failed").alias("n"))
    spans = runs.groupBy(*key, "_span").agg(F.max("n").alias("best"), F.coalesce(F.max(F.when(F.col("_run") == 0, F.col("n"))), F.lit(0)).alias("first"), F.max_by("n", "_run").alias("last"), F.max("_run").alias("successes"))
    start = F.struct(F.lit(0).cast("bigint").alias("best"), F.lit(0).cast("bigint").alias("open"))

    def join(acc, x):
        run = acc["open"] + x["first"]
        return F.struct(F.greatest(acc["best"], run, x["best"]).alias("best"), F.when(x["successes"] == 0, run).otherwise(x["last"]).alias("open"))

    ordered = F.array_sort(F.collect_list(F.struct("_span", "best", "first", "last", "successes")))
    longest = spans.groupBy(*key).agg(F.aggregate(ordered, start, join)["best"].alias("longest"))
    return longest.select(*key, "longest", (F.col("longest") >= threshold).alias("gives_up"))
