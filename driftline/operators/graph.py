"""Order of things that depend on each other, and the cycles that they form.

Edges (src, dst) say that src needs dst.  Nodes are placed from the sinks up; a
round does two things.  It places nodes that need only placed ones, and takes
these out of the edges (what they were worth stays as the node's ``floor``).
And a node that needs one other node steps aside: who needs it now needs that
other one, at the sum of both lengths.  So a chain halves each round, and edges
that are settled are not read again.  What is left reaches a cycle.  It loses
nodes that nothing needs, while that takes many, and is split into strongly
connected components by searches forward and backward, several at once.

No step collects a node's edges: a hub's rows are combined before each shuffle,
joins are of written tables, which adaptive execution may split, and rows
without a dst take part in none.  What a round has to know of its rows is
observed while they are written, so it costs no job of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.sources.scratch import append, new_path, observed, stage

#: Lengths stop growing here: on a cycle they would double each round.  No
#: path of nodes that can be placed is that long.
LONGEST = 1 << 40

#: Searches that run at once, each with strengths of its own.  A search cuts few
#: of the edges between components where these follow each other like a chain;
#: what four leave uncut is the product of what each would leave.
SEARCHES = 4
#: Bits of a mark that number its node.
NUMBER = 47
MARKS = [f"m{i}" for i in range(SEARCHES)]


def ends(edges: DataFrame) -> DataFrame:
    """The distinct nodes of ``edges``."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def _merged(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.max("w").alias("w"))


def _needs(edges: DataFrame) -> DataFrame:
    """Per src: its floor (edges without dst), how many nodes it needs, one of
    them and that one's length."""
    floor = F.max(F.when(F.col("dst").isNull(), F.col("w"))).alias("floor")
    return edges.groupBy("src").agg(floor, F.count("dst").alias("n"), F.max("dst").alias("next"), F.max(F.when(F.col("dst").isNotNull(), F.col("w"))).alias("far"))


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, level) of nodes that need no cycle, (node) of the others).  Edges
    are distinct and without nulls.  A level is the longest way to a sink."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    nothing = F.lit(None).cast(kind)
    to = lambda dst, w: F.struct(dst.alias("dst"), F.least(w, F.lit(LONGEST)).alias("w"))
    seen = edges.select("src", F.lit(1).alias("needs")).union(edges.select("dst", F.lit(0)))
    sinks = seen.groupBy("src").agg(F.max("needs").alias("needs")).where("needs = 0")
    left = edges.select("src", "dst", F.lit(1).cast("long").alias("w")).union(sinks.select("src", nothing, F.lit(0).cast("long")))
    rounds, k = new_path(spark, "needs"), 0
    while True:
        needs, got = observed(_needs(left), "needs", f"{rounds}/round={k}", found=F.count_if(F.col("n") == 0))
        if got["found"] in (0, got["rows"]):
            break
        # settled nodes leave the edges: nothing but floors is left of those that are ready
        ready = needs.where("n = 0").select(F.col("src").alias("dst"), F.col("floor").alias("level"))
        settled = F.when(F.col("level").isNull(), to(F.col("dst"), F.col("w"))).otherwise(to(nothing, F.col("w") + F.col("level")))
        waiting = left.where("dst is not null").join(ready, "dst", "left").select("src", settled.alias("e")).select("src", "e.*")
        floors = needs.where("n > 0 and floor is not null").select("src", nothing.alias("dst"), F.col("floor").alias("w"))
        waiting = stage(waiting.union(floors), "waiting")
        # and nodes that need one other step aside
        by = _needs(waiting).select(F.col("src").alias("dst"), "floor", "n", "next", "far")
        both, w = waiting.where("dst is not null").join(by, "dst", "left"), F.col("w")
        floor = to(nothing, F.when(F.col("floor").isNotNull(), w + F.col("floor")))
        ways = (
            F.when(F.col("n") == 0, F.array(floor))
            .when((F.col("n") == 1) & (F.col("next") != F.col("dst")), F.when(F.col("floor").isNull(), F.array(to(F.col("next"), w + F.col("far")))).otherwise(F.array(to(F.col("next"), w + F.col("far")), floor)))
            .otherwise(F.array(to(F.col("dst"), w)))
        )
        moved = both.select("src", F.explode(ways).alias("e")).select("src", "e.*")
        left, k = stage(_merged(moved.union(waiting.where("dst is null"))), "open"), k + 1
    placed = spark.read.schema(needs.schema).parquet(rounds).where("n = 0").select(F.col("src").alias("node"), F.col("floor").alias("level"))
    return placed, needs.where("n > 0").select(F.col("src").alias("node"))


def trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` less those of nodes that no edge comes to, round by round while
    a round takes a tenth of them; so a long way to a cycle is left to others."""
    left, now = observed(edges, "inner")
    while True:
        was = now["rows"]
        left, now = observed(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "inner")
        if 10 * now["rows"] > 9 * was or not now["rows"]:
            return left


def _at(mark: str) -> Column:
    """The number in a mark."""
    return F.expr(f"{mark} & {(1 << NUMBER) - 1}L")


def _strongest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ahead, m0, ...): per search the mark of the strongest node that
    reaches each node, and in a row of its own (not ahead) of the strongest that
    the node reaches, itself included.  Nodes are numbers below 2^NUMBER; a mark
    is a random strength above the number, so marks are unlike and aggregate as
    longs.  A node also takes what the strongest node of one search, another
    each round, has so far, so that ways of any length take few rounds."""
    own = [F.expr(f"shiftleft(xxhash64(node, {k}), {NUMBER}) | node").alias(mark) for k, mark in enumerate(MARKS)]
    to = lambda src, dst, ahead: edges.select(F.col(src).alias("src"), F.lit(ahead).alias("ahead"), F.col(dst).alias("dst"))
    ways, _ = observed(to("src", "dst", True).union(to("dst", "src", False)), "ways")
    steps = ways
    now, was, k = nodes.select("node", F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead"), *own), None, 0
    while True:
        passed = steps.join(now.withColumnRenamed("node", "src"), ["src", "ahead"]).select(F.col("dst").alias("node"), "ahead", *MARKS)
        best = now.union(passed).groupBy("node", "ahead").agg(*(F.max(mark).alias(mark) for mark in MARKS))
        now, got = observed(best, "strongest", state=F.sum(F.xxhash64("node", "ahead", *MARKS).cast("decimal(38,0)")))
        if got["state"] == was:
            return now
        was, k = got["state"], k + 1
        steps = ways.union(now.select(_at(MARKS[k % SEARCHES]).alias("src"), "ahead", F.col("node").alias("dst")).where("src <> dst"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected component of each node of
    ``edges`` (distinct, without nulls), named by its smallest node.  All of a
    component find the same strongest nodes.  One that reaches them and that
    they reach names them; the others go on among those that found the same."""
    spark = edges.sparkSession
    numbers, got = observed(ends(edges).select("node", F.monotonically_increasing_id().alias("id")), "numbers", top=F.max("id"))
    if (got["top"] or 0) >> NUMBER:
        raise ValueError("too many partitions to number the nodes in")
    number = lambda end, to: numbers.select(F.col("node").alias(end), F.col("id").alias(to))
    edges = edges.where("src <> dst").join(number("src", "a"), "src").join(number("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges, got = observed(edges, "inner")
    found = new_path(spark, "components")
    append(spark.createDataFrame([], "node long, root long"), found)
    while got["rows"]:
        strongest = _strongest(edges, observed(ends(edges), "nodes")[0])
        both = strongest.where("ahead").drop("ahead").join(strongest.where("not ahead").select("node", *(F.col(mark).alias(f"back_{mark}") for mark in MARKS)), "node")
        root = F.coalesce(*(F.when(F.col(mark) == F.col(f"back_{mark}"), _at(mark)) for mark in MARKS))
        rooted, _ = observed(both.select("node", root.alias("root"), F.xxhash64(*both.columns[1:]).alias("finds")), "rooted")
        append(rooted.where("root is not null").select("node", "root"), found)
        # equal hashes of different finds would only keep an edge longer
        color = lambda end, c: rooted.where("root is null").select(F.col("node").alias(end), F.col("finds").alias(c))  # noqa: B023, E731
        inner = edges.join(color("src", "a"), "src").join(color("dst", "b"), "dst").where("a = b").select("src", "dst")
        edges, got = observed(inner, "inner")
    rooted = spark.read.schema("node long, root long").parquet(found).withColumnRenamed("node", "id")
    rooted = numbers.join(rooted, "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def dependency_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level, component, on_cycle) of each distinct node of ``nodes``.

    A level is one above the highest that the node needs, and null for nodes on
    cycles and those that need them; ``component`` is the smallest node of those
    that need each other with it, itself if it is on no cycle.  Edges with a
    null are ignored, repeats count once; a node that only edges name is at
    level 0 if it needs nothing.  No edges: all are at level 0.
    """
    edges = stage(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "edges")
    levels, rest = peel(edges)
    if rest.isEmpty():  # no cycles
        out = nodes.select("node").distinct().join(levels, "node", "left")
        return out.select("node", F.coalesce("level", F.lit(0)).cast("int").alias("level"), F.col("node").alias("component"), F.lit(False).alias("on_cycle"))
    # what needs one of the rest is of the rest
    knots = trimmed(edges.join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    parts = components(knots)
    own = knots.where("src = dst").select(F.col("src").alias("node"))
    many = parts.groupBy("component").agg(F.count("*").alias("many"))
    cyclic = parts.join(many, "component").where("many > 1").select("node", "component")
    cyclic = cyclic.union(own.join(cyclic, "node", "left_anti").select("node", "node"))
    held = rest.join(cyclic, "node", "left").select("node", F.lit(None).cast("long").alias("level"), "component", F.lit(True).alias("held"))
    known = held.union(levels.select("node", "level", F.lit(None).cast(rest.schema["node"].dataType), F.lit(False)))
    out = nodes.select("node").distinct().join(known, "node", "left")
    level = F.when(F.coalesce("held", F.lit(False)), F.lit(None)).otherwise(F.coalesce("level", F.lit(0))).cast("int")
    return out.select("node", level.alias("level"), F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("on_cycle"))
