"""Near-duplicate vectors by spherical k-means cells.

Equal vectors are counted first and compared once.  Cell centres are fitted by
spherical k-means on a bounded sample; every vector then lives in the cell of
its nearest centre.  A vector also visits each cell whose border (the plane
between the two centres) lies within ``reach`` times half the linking angle.
A pair at the threshold that is parted by a border lies within the whole angle
of it on both sides together, so one of the two is within half: with the
default reach of 1 no link is lost.  A smaller reach moves less and may lose
links.  Within a cell, blocks of vectors are compared by matrix products; two
visitors are not compared, and a pair that meets in two cells counts in the
smaller one.  Links are counted per vector and joined to groups, and the
vector of the smallest id represents its group.

Scale: a task compares two blocks of at most ``BLOCK`` components each, in
strips, so its memory is bounded; a cell of any size is dealt to pairs of
blocks.  Copies never meet each other, and no pairs are written: a task returns
a count and one label per vector.  Centres (``CELLS`` at most) are broadcast.
Comparing the different vectors of one tight group stays quadratic, and so does
the whole where vectors have no clusters.

Sample: the ``SAMPLE`` different vectors of smallest hash, or as many as have
``SAMPLE_COMPONENTS`` components.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; a shorter vector has zeros for what is missing;
rows with equal vectors are linked, also if their ids are equal or null; a
group is named by its smallest id that is not null (null if it has none); other
columns are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship
from .ngram_join import MOVED, forest, packed, roots_of

SAMPLE, SAMPLE_COMPONENTS, CELLS, PER_CELL, ROUNDS = 16_384, 1 << 22, 4096, 4096, 10
#: Components of a block; products of a strip; rows that may be broadcast.
BLOCK, STRIP, BROADCAST_ROWS = 1 << 20, 1 << 21, 200_000
#: Cosines this close to the threshold are computed again, summed exactly.
CLOSE = 1e-12


def unit_rows(vectors: list[bytes], dims: int) -> np.ndarray:
    """Vectors (bytes of doubles) as rows of length 1."""
    if all(len(v) == dims * 8 for v in vectors):
        out = np.frombuffer(b"".join(vectors)).reshape(-1, dims).copy()
    else:
        out = np.zeros((len(vectors), dims))
        for i, v in enumerate(vectors):
            out[i, : len(v) // 8] = np.frombuffer(v)
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def spherical_k_means(u: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres of length 1, from the first k rows on."""
    centres = u[:k].copy()
    for _ in range(rounds):
        home = (u @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, u)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = sums[length > 1e-9] / length[length > 1e-9, None]
    return centres


def visits(near: np.ndarray, home: np.ndarray, apart: np.ndarray, most: float) -> np.ndarray:
    """(vectors, cells): cells whose border with a vector's own is within
    ``most`` (a sine) of it.  ``near`` has the products with the centres."""
    own = near[np.arange(len(home)), home][:, None]
    gap = apart[home]
    out = (own - near) <= most * gap + 1e-9
    out[np.arange(len(home)), home] = False
    return out


def _pack(batches: Iterator) -> Iterator:
    """Vectors as bytes of doubles."""
    import pyarrow as pa

    for batch in batches:
        v = batch.column(batch.schema.get_field_index("v"))
        flat, offsets = v.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.concatenate([[0], np.cumsum(v.value_lengths().fill_null(0).to_numpy())])
        packed_rows = pa.array([flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("id", "c1", "c2")] + [packed_rows], names=["id", "c1", "c2", "v"])


def _assign(shared, dims: int, most: float):
    """Rows (rid, copies, v): one row per cell that the vector lives in or
    visits; the row in its own cell has the list of its visits."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centres = shared.value
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)))
        step = max(1, STRIP // max(dims, len(centres)))
        for batch in batches:
            rid, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(rid), step):
                part = batch.column(2).slice(a, step)
                near = unit_rows(part.to_pylist(), dims) @ centres.T
                home = near.argmax(axis=1)
                seen = visits(near, home, apart, most)
                row, cell = np.nonzero(seen)
                lists = [c.tolist() for c in np.split(cell, np.cumsum(seen.sum(axis=1))[:-1])]
                at = np.concatenate([np.arange(len(home)), row])
                columns = [rid[a + at], copies[a + at], np.concatenate([home, cell]).astype(np.int32), home[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(lists + [None] * len(row), pa.list_(pa.int32())), part.take(pa.array(at))], names=["rid", "copies", "cell", "home", "visits", "v"])

    return run


def compare(u: np.ndarray, rid: np.ndarray, copies: np.ndarray, side: np.ndarray, cosine: float, counts=None) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's linked copies and the smallest ``rid`` that its links lead
    to, among vectors in order of ``rid``.  Those of side 0 are compared with
    those of side 1, or with each other if there is no side 1.  ``counts`` says
    which pairs of (a of side 0, b of side 1) count here."""
    mine = np.flatnonzero(side == 0)
    one = len(mine) == len(side)
    theirs = mine if one else np.flatnonzero(side == 1)
    links, label = np.zeros(len(rid)), np.arange(len(rid))
    left, right = u[mine], u[theirs].T
    step = max(1, STRIP // max(1, len(theirs)))
    for first in range(0, len(mine), step):
        cos = left[first : first + step] @ right
        near = cos >= cosine - CLOSE
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if one:  # every vector is near itself
            rows = rows[near[rows].sum(axis=1) > 1]
        if not len(rows):
            continue
        a, b = mine[first + rows], theirs[columns]
        cos, near = cos[np.ix_(rows, columns)], near[np.ix_(rows, columns)]
        for i, j in zip(*np.nonzero(near & (cos < cosine + CLOSE))):
            near[i, j] = math.fsum(u[a[i]] * u[b[j]]) >= cosine
        if one:
            near &= a[:, None] != b[None, :]
        if counts is not None:
            near &= counts(a, b)
        links[a] += near @ copies[b]
        if not one:
            links[b] += near.T @ copies[a]
        i, j = np.nonzero(near & (label[a][:, None] != label[b][None, :]))
        if len(i):
            label = forest(len(rid), label[a[i]], label[b[j]])[label]
    return links, rid[label]


def _cells(dims: int, cosine: float):
    def run(key, pdf):
        import pandas as pd

        cell, guests = key[0], key[1]
        pdf = pdf.sort_values("rid", ignore_index=True)
        side, home = pdf["side"].to_numpy(), pdf["home"].to_numpy()
        if key[2] != key[3] and pdf["side"].nunique() < 2 or guests and pdf["side"].nunique() < 2:
            return pd.DataFrame({"rid": [], "links": [], "label": []}).astype("int64")
        counts = None
        if guests:  # a pair that also meets in the visitor's cell counts in the smaller one
            cells, code = np.unique(home, return_inverse=True)
            visited = np.zeros((len(pdf), len(cells)), bool)
            for i in np.flatnonzero(side == 0):
                visited[i, np.searchsorted(cells, np.intersect1d(pdf["visits"][i], cells))] = True

            def counts(a, b):
                return ~visited[a][:, code[b]] | (home[b] > cell)[None, :]

        links, label = compare(unit_rows(list(pdf["v"]), dims), pdf["rid"].to_numpy(), pdf["copies"].to_numpy(np.float64), side, cosine, counts)
        some = links > 0
        return pd.DataFrame({"rid": pdf["rid"][some], "links": links[some].astype(np.int64), "label": label[some]})

    return run


def linked(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", reach: float = 1.0, per_cell: int = PER_CELL) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.coalesce(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    # -0.0 becomes 0.0, and zeros at the end go, so that equal vectors have equal bytes
    v = F.transform(x, lambda c: c + F.lit(0.0))
    last = F.array_max(F.transform(v, lambda c, i: F.when(c != 0, i + 1).otherwise(0)))
    slim = vectors.select(F.col(id_col).alias("id"), F.when(fine, F.slice(v, 1, last)).alias("v"))
    rows = slim.withColumns({"c1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "c2": F.xxhash64(F.lit(1), "v")})
    rows = save(rows.mapInArrow(_pack, f"id {kind}, c1 long, c2 long, v binary"), "dedup-rows")
    sets = rows.where("c1 is not null").groupBy("c1", "c2", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    sets = save(sets.withColumn("rid", F.monotonically_increasing_id()), "dedup-sets")
    facts = sets.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("bytes")).first()
    if not facts["n"]:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n, dims = facts["n"], facts["bytes"] // 8

    some = max(1, min(SAMPLE, SAMPLE_COMPONENTS // dims))
    k = max(1, min(CELLS, n // per_cell, some // 8))
    centres = np.ones((1, dims)) / math.sqrt(dims)
    if k > 1:
        centres = spherical_k_means(unit_rows([r["v"] for r in sets.orderBy("c1", "c2").limit(some).select("v").collect()], dims), k)
    shared = spark.sparkContext.broadcast(centres)
    most = math.sin(reach * math.acos(cosine) / 2)
    at = save(sets.select("rid", "copies", "v").mapInArrow(_assign(shared, dims, most), "rid long, copies long, cell int, home int, visits array<int>, v binary"), "dedup-cells")
    per = max(1, BLOCK // dims)
    lives = F.col("home") == F.col("cell")
    blocks = lambda of: F.ceil(F.count_if(of) / per).cast("int")
    sizes = at.groupBy("cell").agg(blocks(lives).alias("own"), blocks(~lives).alias("guests"))
    # a row per cell, of which there are CELLS at most
    dealt = at.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("rid"), F.when(lives, F.col("own")).otherwise(F.col("guests"))).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda b: b < n)
    task = lambda guests, i, j, side: F.struct(F.lit(guests).alias("guests"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    block = F.col("block")
    # residents meet residents, block by block, and each block of visitors
    among = F.transform(upto(F.col("own")), lambda b: task(False, F.least(b, block), F.greatest(b, block), b < block))
    with_guests = F.transform(upto(F.col("guests")), lambda b: task(True, block, b, F.lit(0)))
    visiting = F.transform(upto(F.col("own")), lambda b: task(True, b, block, F.lit(1)))
    dealt = dealt.withColumn("task", F.explode(F.when(lives, F.concat(among, with_guests)).otherwise(visiting)))
    dealt = dealt.select("cell", "task.*", "rid", "copies", "home", "visits", "v")
    found = save(dealt.groupBy("cell", "guests", "i", "j").applyInPandas(_cells(dims, cosine), "rid long, links long, label long"), "dedup-links")

    roots = roots_of(found.where("label <> rid").select(F.col("rid").alias("src"), F.col("label").alias("dst")), "dedup")
    comps = roots.union(roots.select(F.col("dst").alias("src"), "dst").distinct())
    many = roots.count()
    comps = save(packed(comps.join(sets.select(F.col("rid").alias("src"), "least").hint("merge"), "src"), many, MOVED), "dedup-comps")
    names = comps.groupBy("dst").agg(F.min("least").alias("name"))
    named = comps.select("src", "dst").join(names, "dst").select("src", "name")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    of_set = sets.select("rid", "c1", "c2", "copies", "least").join(links, "rid", "left").where("copies > 1 or links > 0")
    of_set = of_set.join(named, F.col("rid") == F.col("src"), "left")
    of_set = of_set.select(F.col("c1").alias("m1"), F.col("c2").alias("m2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.when(F.col("src").isNull(), F.col("least")).otherwise(F.col("name")).alias("name"))
    of_set = save(of_set, "dedup-named")
    near = F.broadcast(of_set) if of_set.count() <= BROADCAST_ROWS else of_set.hint("merge")
    out = rows.select("id", "c1", "c2").join(near, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("m1").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def representatives(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", **kw) -> DataFrame:
    """The rows of ``vectors`` whose id represents its group."""
    kept = linked(vectors, cosine, id_col, vector, **kw).where("kept").select(F.col(id_col).alias("_own")).distinct()
    rows = vectors.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"))
    return rows.join(kept, F.col("_id").eqNullSafe(F.col("_own")), "left_semi").select("row.*")
