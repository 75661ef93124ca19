"""Sharding by Karmarkar-Karp differencing of indivisible groups.

Rows with equal texts form a group, which stays in one shard.  A partial
partition holds ``shards`` sums; differencing repeatedly takes the two partial
partitions with the largest spread (largest less smallest sum) and adds them
in opposite order, the largest sum of one to the smallest of the other.

Scale: groups are summed before anything moves (a map-side combine, so a text
with a third of all rows is one record).  Each Spark partition differences its
own groups and leaves one partial partition (one per ``per_task`` groups).
Those are differenced in the same way, ``wide`` at a time, in tasks and at last
on the driver, which sees ``shards`` sums of at most ``wide`` and no documents.  A row's slot is its rank within (shard, cell),
a cell being a hash of its id, plus the rows of earlier cells.

Defined results: a null text has 0 bytes and a null crc; all null texts form
one group; an empty text is a group like any other; repeated rows stay
together; other columns are not read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

CELLS = 512
MIN_PARTS = 32


def difference(sums: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """For partial partitions (each ``shards`` sums), the shard of each of
    their slots, as differencing places them.  Ties go by position."""
    if not sums:
        return []
    shards = len(sums[0])
    heap = []  # (-spread, order, sums descending, the slots merged into each)
    for k, s in enumerate(sums):
        order = sorted(range(shards), key=lambda j: (-s[j], j))
        top = [s[j] for j in order]
        heap.append((top[-1] - top[0], k, top, [(k, j) for j in order]))
    heapq.heapify(heap)
    count = len(sums)
    while len(heap) > 1:
        _, ka, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        merged = sorted(((x + y, (m, n)) for x, y, m, n in zip(a, reversed(b), na, reversed(nb))), key=lambda t: -t[0])
        top = [t[0] for t in merged]
        low = top[-1]
        # only differences matter from here on; equal parts are dropped to keep numbers small
        heapq.heappush(heap, (low - top[0], count, [x - low for x in top], [t[1] for t in merged]))
        count += 1
    out = [[0] * shards for _ in sums]
    for shard, node in enumerate(heap[0][3]):
        stack = [node]
        while stack:
            left, right = stack.pop()
            if isinstance(left, tuple):
                stack += [left, right]
            else:
                out[left][right] = shard
    return [tuple(x) for x in out]


def _differenced(shards: int):
    """A partition's groups (gid, part, bytes) with the slot of each."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        frames = list(batches)  # at most about per_task groups of three numbers each
        if not frames:
            return
        g = pd.concat(frames)
        for part, own in g.groupby("part", sort=True):
            own = own.sort_values(["bytes", "gid"], ascending=[False, True])
            placed = difference([(int(b),) + (0,) * (shards - 1) for b in own["bytes"]])
            yield pd.DataFrame({"gid": own["gid"], "part": part, "bytes": own["bytes"], "local": [p[0] for p in placed]})

    return run


def group_of(text: Column) -> Column:
    """16 bytes that equal texts share; null texts share another value."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"").cast("binary"))


def _merged(shards: int):
    """Partial partitions of one group as one: the slot of each one's sums."""

    def run(pdf):
        import pandas as pd

        sums = pdf.pivot(index="part", columns="local", values="bytes").reindex(columns=range(shards), fill_value=0).fillna(0)
        placed = difference([tuple(int(x) for x in row) for row in sums.to_numpy()])
        rows = [(part, local, slot) for part, slots in zip(sums.index, placed) for local, slot in enumerate(slots)]
        return pd.DataFrame(rows, columns=["part", "local", "slot"]).assign(above=pdf["above"].iloc[0])

    return run


def _placed_parts(sums: DataFrame, parts: int, shards: int, wide: int) -> DataFrame:
    """(part, local, shard) from the sums of partial partitions, ``wide`` of
    which are differenced at once: in tasks, level by level, until the rest is
    few enough for the driver."""
    levels = []
    while parts > wide:
        sums = save(sums, "shard-sums")
        above = sums.withColumn("above", F.floor(F.col("part") / wide).cast("int"))
        level = save(above.groupBy("above").applyInPandas(_merged(shards), "part int, local int, slot int, above int"), "shard-level")
        sums = sums.join(level, ["part", "local"]).groupBy(F.col("above").alias("part"), F.col("slot").alias("local")).agg(F.sum("bytes").alias("bytes"))
        levels.append(level)
        parts = -(-parts // wide)
    last: dict[int, list[int]] = {}
    for r in sums.collect():  # shards sums of each of at most ``wide`` parts
        last.setdefault(r["part"], [0] * shards)[r["local"]] = r["bytes"]
    keys = sorted(last)
    final = difference([tuple(last[k]) for k in keys])
    where = sums.sparkSession.createDataFrame([(k, j, final[i][j]) for i, k in enumerate(keys) for j in range(shards)], "part int, local int, shard int")
    for level in reversed(levels):
        top = where.select(F.col("part").alias("above"), F.col("local").alias("slot"), "shard")
        where = level.join(top, ["above", "slot"]).select("part", "local", "shard")
    return where


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", per_task: int = 100_000, wide: int = 1024) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot,
    grown_shard.  The law is ``bytes``: sizes near equal, whole groups."""
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        group_of(F.col(text)).alias("gid"),
    )
    slim = save(slim, "shard-sizes")
    groups = save(slim.groupBy("gid").agg(F.sum("size").alias("bytes")), "shard-groups")
    # from the data alone, so that reruns on another cluster agree
    parts = max(MIN_PARTS, -(-groups.count() // per_task))
    keyed = groups.withColumn("part", F.pmod(F.xxhash64("gid"), F.lit(parts)).cast("int")).repartition(parts, "part")
    placed = save(keyed.mapInPandas(_differenced(shards), "gid binary, part int, bytes long, local int"), "shard-placed")
    where = _placed_parts(placed.groupBy("part", "local").agg(F.sum("bytes").alias("bytes")), parts, shards, wide)
    # the map has shards rows per part, so Spark may broadcast it by its size
    located = save(placed.join(where, ["part", "local"]).select("gid", "shard"), "shard-map")
    out = slim.join(located, "gid").withColumn("cell", F.pmod(F.xxhash64("id", "size"), F.lit(CELLS)).cast("int"))
    out = save(out.select("id", "size", "text_crc32", "shard", "cell"), "shard-rows")
    cells = out.groupBy("shard", "cell").agg(F.count("*").alias("rows"))  # at most shards x CELLS rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("shard").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size"))
    out = out.withColumn("rank", rank).join(F.broadcast(cells), (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
