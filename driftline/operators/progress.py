"""Progress, speed, lag, status and reports over unit, page and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.scan import scan

from driftline.functions.cells import duration_seconds


def remaining_work(units: DataFrame) -> DataFrame:
    """Valid units that are not complete offline and not skipped."""
    valid = F.col("status").isin("OK", "Failed")
    return units.where(valid & ~(F.col("copy_complete") & ~F.col("online")) & ~F.col("skipped"))


def log_at_level(log: DataFrame, level: int) -> DataFrame:
    return log.where(F.col("level") <= level)


def log_search(log: DataFrame, text: str) -> DataFrame:
    """Entries whose message contains ``text``, without case."""
    return log.where(F.contains(F.lower("message"), F.lit(text.lower())))


def job_totals(units: DataFrame) -> DataFrame:
    """Per job: sums of rows, and numbers of units by state.  Rows of counter
    tables do not count online; wildcard entries never do."""
    counted = ~(F.col("is_counter") & F.col("online"))
    return units.where("tbl <> '*'").groupBy("job").agg(
        F.sum(F.when(counted, F.col("copied")).otherwise(0)).alias("copied"),
        F.sum(F.when(counted, F.col("total")).otherwise(0)).alias("total"),
        F.count_if("copy_complete").alias("complete"),
        F.count_if(~F.col("copy_complete") & (F.col("copied") > 0)).alias("in_progress"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.count_if("is_counter").alias("counters"),
        F.sum(F.when(F.col("online"), F.col("replayed")).otherwise(0)).alias("replayed"),
    )


def payload_bytes(rows: DataFrame, columns: list[str]) -> Column:
    """Estimated bytes of a row: two per character of texts, the length of
    binaries, eight of any other value, none of nulls."""
    kinds = dict(rows.select(*columns).dtypes)
    size = {"string": lambda c: F.char_length(c) * 2, "binary": lambda c: F.octet_length(c)}
    each = [F.when(F.col(c).isNotNull(), size.get(kinds[c], lambda _: F.lit(8))(F.col(c))).otherwise(0) for c in columns]
    return sum(each[1:], each[0]).cast("long")


def page_stats(pages: DataFrame, by: list[str], columns: list[str], latency: str) -> DataFrame:
    """Rows done and failed, the sum of latencies and bytes per group of pages."""
    return pages.groupBy(*by).agg(
        F.count_if("done").alias("rows_done"), F.count_if(~F.col("done")).alias("rows_failed"),
        F.sum(latency).alias("latency_ms"), F.sum(payload_bytes(pages, columns)).alias("bytes"),
    )


def average_latency(pages: DataFrame, by: list[str], read: str, write: str, replayed: Column) -> DataFrame:
    """Per group whole milliseconds of reading and writing a page, and the
    milliseconds of writing a replayed item (null without any)."""
    sums = pages.groupBy(*by).agg(F.sum(read).alias("r"), F.sum(write).alias("w"), F.count("*").alias("n"), F.sum(F.when(replayed, F.col(write))).alias("rw"), F.count_if(replayed).alias("items"))
    return sums.select(*by, F.expr("r div n").alias("read_ms"), F.expr("w div n").alias("write_ms"), F.when((F.col("items") > 0) & (F.col("rw") > 0), F.col("rw") / F.col("items")).alias("item_ms"))


def bottleneck(read_ms: Column, write_ms: Column) -> Column:
    return F.when(read_ms > 2 * write_ms, "READ-BOUND").when(write_ms > 2 * read_ms, "WRITE-BOUND").otherwise("BALANCED")


def progress_percent(written: Column, total: Column) -> Column:
    """At most 99.9 until a unit is complete; null without a total."""
    return F.when(total > 0, F.least(F.lit(99.9), written / total * 100))


def stale_total(written: Column, total: Column) -> Column:
    """Whether more was written than the total says, so the total is old."""
    return F.coalesce((total > 0) & (written > total), F.lit(False))


def job_report(jobs: DataFrame, units: DataFrame) -> DataFrame:
    """A row per unit with its job's name, status, counts, percent, duration of
    its copy in seconds and replay counters."""
    both = units.join(jobs, "job")
    return both.select(
        "job_name", "tbl", "status", "copied", "failed", progress_percent(F.col("copied"), F.col("total")).alias("percent"),
        stale_total(F.col("copied"), F.col("total")).alias("stale"), duration_seconds(F.col("started"), F.col("ended")).alias("seconds"),
        F.when(F.col("online"), F.col("replayed")).alias("replayed"), F.when(F.col("online"), F.col("replay_errors")).alias("replay_errors"),
    )


def recent_speed(samples: DataFrame, by: str, t: str = "t", copied: str = "copied") -> DataFrame:
    """Rows a second since the sample before; for the first, since the start
    (``started``)."""
    each = scan(samples, [by], t, lags={"_copied": F.col(copied), "_t": F.col(t)}, span=SPAN)
    rows, secs = F.col(copied) - F.col("_copied"), F.col(t) - F.col("_t")
    overall = F.when(F.col(t) > F.col("started"), F.col(copied) / (F.col(t) - F.col("started")))
    return each.withColumn("speed", F.coalesce(F.when(secs > 0, rows / secs), overall)).drop("_copied", "_t")


def speed_sum(samples: DataFrame, by: str, t: str = "t", copied: str = "copied", least: int = 0) -> DataFrame:
    """One row: the sum of the whole rows a second since the sample before that
    are above ``least``."""
    each = scan(samples, [by], t, lags={"_copied": F.col(copied), "_t": F.col(t)}, span=SPAN)
    speed = F.when(F.col(t) > F.col("_t"), F.floor((F.col(copied) - F.col("_copied")) / (F.col(t) - F.col("_t"))))
    return each.agg(F.coalesce(F.sum(F.when(speed > least, speed - least)), F.lit(0)).cast("long").alias("speed"))


def sticky_last(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The last value that was not zero, up to each sample."""
    return scan(samples, [by], order, lasts={"sticky": F.nullif(F.col(value), F.lit(0))}, span=SPAN)


def session_delta(samples: DataFrame, session: list[str], order: str, copied: str = "copied") -> DataFrame:
    """What was copied since the session's first sample."""
    each = scan(samples, session, order, firsts={"_first": F.col(copied)}, span=SPAN)
    return each.withColumn("delta", F.col(copied) - F.col("_first")).drop("_first")


#: Samples' order values (hours or seconds) in one span.
SPAN = 100_000


def valid_units(units: DataFrame) -> DataFrame:
    """Units that exist and can be worked on."""
    return units.where(F.col("status").isin("OK", "Failed"))


def units_of_jobs(units: DataFrame, jobs: DataFrame) -> DataFrame:
    """``units`` with ``kept``: whether the unit's job is in ``jobs``.  One
    join of the distinct jobs marks both kinds; a null job is never kept."""
    known = jobs.select(F.col("job").alias("_job")).distinct()
    marked = units.join(known, F.col("job") == F.col("_job"), "left")
    return marked.withColumn("kept", F.col("_job").isNotNull()).drop("_job")


def processed_totals(units: DataFrame) -> DataFrame:
    """Per job: rows inserted, and rows that failed units have not copied."""
    return units.groupBy("job").agg(F.sum("copied").alias("inserted"), F.sum(F.when(F.col("status") == "Failed", F.col("total") - F.col("copied")).otherwise(0)).alias("failed"))


def total_rows(units: DataFrame) -> DataFrame:
    """``total_rows`` of each unit: the estimate, or what was copied if more."""
    return units.withColumn("total_rows", F.greatest("copied", "total"))


def max_lag(last: DataFrame, now: int, low: int = 30, t: str = "last") -> DataFrame:
    """One row: the largest lag of any range, and whether it is low."""
    return last.agg(F.max(F.lit(now) - F.col(t)).alias("lag")).withColumn("low", F.col("lag") < low)


def event_lag(events: DataFrame, by: list[str], now: int, wt: str = "wt", done: str = "done", polled: str = "polled") -> DataFrame:
    """Per group, in whole seconds: ``poll_age`` since the last poll, ``lag``
    since the newest event that is written (``wt`` in microseconds), and
    ``behind``, how far that is from the newest event seen.  A poll that finds
    nothing makes the first small, but not the second.  Where nothing is
    written, ``lag`` and ``behind`` are null; a null ``done`` is not written."""
    each = events.groupBy(*by).agg(F.max(polled).alias("_polled"), F.max(wt).alias("_seen"), F.max(F.when(F.col(done), F.col(wt))).alias("_written"))
    return each.select(*by, (F.lit(now) - F.col("_polled")).alias("poll_age"), F.expr(f"({now} * 1000000L - _written) div 1000000").alias("lag"), F.expr("(_seen - _written) div 1000000").alias("behind"))


def cutover_ready(units: DataFrame) -> DataFrame:
    """Jobs with at least one unit, all complete or not found."""
    return units.groupBy("job").agg(F.bool_and(F.col("copy_complete") | (F.col("status") == "NotFound")).alias("ready"))


def offline_complete(units: DataFrame) -> DataFrame:
    """Offline jobs whose valid units (at least one unit in all) are complete."""
    valid = F.col("status").isin("OK", "Failed")
    return units.where(~F.col("online")).groupBy("job").agg(F.bool_and(~valid | F.col("copy_complete")).alias("complete"))


def final_status(units: DataFrame) -> DataFrame:
    """Per job, from its units and its columns faulted and command."""
    by = units.groupBy("job").agg(F.bool_or("faulted").alias("f"), F.bool_or(F.col("status") == "Failed").alias("bad"), F.max("command").alias("command"), F.bool_and(~F.col("online") & (F.col("copy_complete") | ~F.col("status").isin("OK", "Failed"))).alias("all_done"))
    status = (
        F.when(F.col("f") | F.col("bad"), "Faulted")
        .when(F.col("command") == "cutover", "Completed")
        .when(F.col("command") == "stop", "Cancelled")
        .when(F.col("command") == "pause", "Paused")
        .when(F.col("all_done"), "Completed")
        .otherwise("Pending")
    )
    return by.select("job", status.alias("final_status"))


def table_state(units: DataFrame) -> DataFrame:
    """A unit's state, the first that holds."""
    done = F.col("copy_complete")
    state = (
        F.when(F.col("status") == "NotFound", "missing")
        .when(F.col("status") == "Failed", "failed")
        .when(F.col("skipped"), "skipped")
        .when(done & F.col("online") & (F.col("job_status") == "Paused"), "replay paused")
        .when(done & F.col("online") & (F.col("job_status") == "Running"), "replaying")
        .when(done, "complete")
        .when((F.col("job_status") == "Paused") & (F.col("copied") > 0), "paused")
        .when(F.col("copied") > 0, "copying")
        .otherwise("pending")
    )
    return units.withColumn("state", state)
