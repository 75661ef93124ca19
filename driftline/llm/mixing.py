"""Mixing sources to target weights by Pareto order sampling.

DataFrame functions only.  A source's target words over its words is its rate
``r``.  Every document gets ``floor(r)`` certain whole copies.  The rest of
the target is sampled without replacement: documents are ranked by random odds
over inclusion odds, ``(u / (1 - u)) / (w * f / (1 - f))`` with ``f = r -
floor(r)``, ``u`` from a hash of the id, and importance ``w`` (longer
documents, up to twice the mean, are likelier).  In rank order documents are
taken until the next would pass the source's remaining words.  Two more
documents may then fill the gap, each the one whose size is nearest to it.

Scale: only ids, sizes and keys are written (once, so the texts are read
once).  Ranks come from sums per (source, key range), so that a source with a
third of all rows is ranked by many tasks; only the range where the target is
reached is sorted.  The table of sources is small: one row per source.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows with equal ids are told apart by a row number, so that
reruns on the same table agree; the random number of a row without an id comes
from its text; a source without words has target 0; other columns may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Key ranges per source; ranks are exact whatever their number.
RANGES = 1024
FILLS = 2


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    runs = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.size(runs).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(source, n, words, target) with one row per source.

    The sources, by code point and null last, weigh ``weights`` in turn and
    share ``share[0] / share[1]`` of all words; no target passes ``most`` times
    its source's words, and what is above goes to the others by weight.
    That end point is found directly: sources fill up in the order of words
    per weight, and the first that stays under its limit fixes the level.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w.cast("long"))
    full = Window.orderBy((F.col("words") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    by = by.select("*", (F.sum("words").over(every) * share[0] - F.coalesce(F.sum("words").over(before), F.lit(0)) * most * share[1]).alias("rest"), (F.sum("w").over(after) * share[1]).alias("per"))
    # level = rest / per at the first source that it leaves below its limit
    below = F.col("rest") <= F.col("words") * most * F.col("per") / F.col("w")
    by = by.withColumn("level", F.min_by(F.struct("rest", "per"), F.when(below, F.struct(F.col("words") / F.col("w"), F.coalesce("source", F.lit("")), F.col("source").isNull()))).over(every))
    capped = F.col("words") * most
    shared = (F.col("w") * F.col("level.rest")).cast("double") / F.col("level.per").cast("double")
    return by.select("source", "n", "words", F.when(F.col("level").isNull(), capped.cast("double")).otherwise(F.least(shared, capped.cast("double"))).alias("target"))


def unit_random(key: Column) -> Column:
    """A number in (0, 1) from 48 bits of the md5 of the key's text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", row: str | None = None) -> DataFrame:
    """One row per document: id, uid (``row``, if that column tells rows apart), size, source, source_size, target and
    ``copies`` (0 to ``most``), the number of times the mix takes it."""
    uid = F.col(row) if row else F.monotonically_increasing_id()
    slim = save(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("nameless"), uid.alias("uid")), "mix-sizes")
    targets = save(source_targets(slim, weights, share, most), "mix-sources")
    # the number of sources is not bounded, so Spark decides whether to broadcast them
    t = targets.select(F.col("source").alias("s"), "n", "words", "target")
    rows = slim.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.least(F.floor(rate), F.lit(most)).cast("long")).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("words"), F.lit(0.0)))
    f = F.col("rest") / F.col("words")
    mean = F.col("words") / F.col("n")
    u = unit_random(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null"), F.col("nameless")))))
    weight = F.least(F.greatest(F.col("size") / mean, F.lit(0.5)), F.lit(2.0))
    key = (u / (1 - u)) / (weight * (f / (1 - f)))
    open_ = (F.col("rest") > 0) & (F.col("size") > 0)
    rows = rows.withColumn("key", F.when(open_, key)).withColumn("range", F.floor(F.col("key") / (1 + F.col("key")) * RANGES))
    rows = save(rows, "mix-keys")

    # words per key range, and before each range
    ranges = rows.where("key is not null").groupBy("source", "range").agg(F.sum("size").alias("in_range"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(upto), F.lit(0)))
    edge = ranges.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_range") > F.col("rest")))
    edge = save(edge.groupBy("source").agg(F.min_by(F.struct("range", "before"), "range").alias("e")).select(F.col("source").alias("s"), F.col("e.range").alias("at"), F.col("e.before").alias("before")), "mix-edges")
    placed = rows.where("key is not null").join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
    rank = Window.partitionBy("source").orderBy("key", "id", "uid")
    fine = placed.where(F.col("range") == F.col("at")).withColumn("upto", F.col("before") + F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, 0)))
    taken = placed.where(F.col("at").isNull() | (F.col("range") < F.col("at"))).select("uid", "source", "size", "key", "id", "rest", F.lit(True).alias("in"))
    taken = taken.union(fine.select("uid", "source", "size", "key", "id", "rest", F.col("upto") <= F.col("rest")))
    taken = taken.union(placed.where(F.col("range") > F.col("at")).select("uid", "source", "size", "key", "id", "rest", F.lit(False)))
    taken = save(taken, "mix-taken")

    for step in range(FILLS):
        gaps = taken.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))), F.lit(0))).alias("gap"))
        gaps = gaps.select(F.col("source").alias("s"), "gap")
        spare = taken.where(~F.col("in")).join(gaps, F.col("source").eqNullSafe(F.col("s")))
        nearer = F.abs(F.col("gap") - F.col("size")) < F.abs(F.col("gap"))
        pick = spare.where(nearer).groupBy("source").agg(F.min_by("uid", F.struct(F.abs(F.col("gap") - F.col("size")), "key", "id", "uid")).alias("pick"))
        pick = save(pick.select(F.col("source").alias("s"), "pick"), f"mix-fill{step}")
        taken = save(taken.join(pick, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("in", F.col("in") | F.coalesce(F.col("uid") == F.col("pick"), F.lit(False))).drop("s", "pick"), "mix-taken")

    drawn = taken.where("in").select(F.col("uid").alias("drawn"))
    out = rows.join(drawn, F.col("uid") == F.col("drawn"), "left")
    copies = F.least(F.col("whole") + F.col("drawn").isNotNull().cast("long"), F.lit(most))
    return out.select(F.col("id").alias(id_col), "uid", "source", "size", F.col("words").alias("source_size"), "target", copies.alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    # rows are held in one struct, so that no name of theirs can clash, and
    # written with their numbers, so that these name the same rows again
    held = save(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-docs")
    slim = held.select(*[F.col("doc")[c].alias(n) for c, n in ((id_col, "id"), (text, "text"), (source, "source"))], "row")
    copies = mix(slim, "id", "text", "source", row="row", **kw).select(F.col("uid").alias("taken"), "copies").where("copies > 0")
    twice = held.join(copies, F.col("row") == F.col("taken")).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return twice.select("doc.*")
