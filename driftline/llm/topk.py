"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length, longest first.  A query's
lower bound for its k-th score gives each bucket a local cosine threshold:
bound / (|query| * longest length in the bucket).  Above 1, the bucket cannot
hold a result.  From ``COORD`` up, candidates are found by coordinate pruning:
in the query's largest coordinates, a vector at that cosine must lie within a
range.  Below it, by length pruning: vectors shorter than bound / |query| are
out.  Products of the candidates are then computed and verified.  A block of
queries meets a bucket at once: in one matrix product if many candidates are
left, else query by query on the candidates' rows.

Scores are exact.  While components are so small that double precision holds
every sum of products, the products are the scores.  Else products decide, with
a margin for rounding, which candidates are verified in whole numbers; a score
beyond 64 bits is given as the nearest long.

Scale: an image (a bucket's vectors, or a block's queries) has at most about
``IMAGE`` components.  A task gets ``per_cell`` buckets and ``per_group``
blocks, so its memory is bounded, and a bucket moves once per ``per_group``
blocks.  First bounds come from the longest bucket, which is broadcast.  Pairs
of groups and cells that the bounds exclude are not formed.  Each task returns
k rows per query, which a second top-k merges.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; a vector shorter or longer than others has zeros for what is
missing; a query does not meet its own row, but does meet other rows with its
id; ties go to the smaller id; rows with a null id take no part; other columns
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

COORD, FOCUS = 0.3, 4
#: Components of an image; share of candidates below which rows are gathered.
IMAGE, FEW = 1 << 18, 0.1
NONE = np.zeros(0, np.int64)


def _unpack(images: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(images), "<i8").reshape(-1, dims)


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, whole: np.ndarray) -> None:
        v = whole.astype(np.float64)
        lengths = np.sqrt((v * v).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.rows, self.whole, self.v, self.lengths = ids[order], rows[order], whole[order], v[order], lengths[order]


def candidates(bucket: Bucket, q: np.ndarray, norms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(queries, vectors): which vectors of the bucket may reach each bound."""
    n = len(bucket.lengths)
    out = np.ones((len(q), n), bool)
    some = (norms > 0) & np.isfinite(bounds)
    if not bucket.lengths[0] or not some.any():
        return out
    unit = q / np.where(norms > 0, norms, 1)[:, None]
    least = np.where(some & (bounds > 0), bounds / np.where(norms > 0, norms, 1), -1.0) * (1 - 1e-9)
    out &= bucket.lengths[None, :] >= least[:, None]  # length pruning
    local = np.where(some, bounds / (np.where(norms > 0, norms, 1) * bucket.lengths[0]), -1.0)
    out[local > 1 + 1e-9] = False
    by = np.flatnonzero((local >= COORD) & (local <= 1 + 1e-9))  # coordinate pruning
    t = np.minimum(local[by] - 1e-9, 1.0)
    order = np.argsort(-np.abs(unit[by]), axis=1)[:, :FOCUS]
    for f in order.T:
        at = unit[by, f]
        spread = np.sqrt(np.maximum(0.0, 1 - at * at)) * np.sqrt(np.maximum(0.0, 1 - t * t))
        # the range of a cosine of at least t: it reaches the pole if the pole is inside
        low, high = np.where(-at >= t, -1.0, at * t - spread), np.where(at >= t, 1.0, at * t + spread)
        c, slack = bucket.v[:, f].T, 1e-6 + 1e-9 * bucket.lengths[None, :]
        out[by] &= (c >= low[:, None] * bucket.lengths[None, :] - slack) & (c <= high[:, None] * bucket.lengths[None, :] + slack)
    return out


def exact_products(whole: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, as the nearest longs."""
    got = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in whole]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in got], np.int64)


def margin(norms: np.ndarray, longest: float, dims: int, exact: bool) -> np.ndarray:
    """How far rounding may move a product."""
    return np.zeros(len(norms)) if exact else norms * longest * (dims + 2) * 2.0**-50


class Block:
    """Queries with the best k rows that they have met so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, whole: np.ndarray, bounds: np.ndarray, k: int, exact: bool) -> None:
        self.ids, self.rows, self.whole, self.bounds, self.k, self.exact = ids, rows, whole, bounds.copy(), k, exact
        self.q = whole.astype(np.float64)
        self.norms = np.sqrt((self.q * self.q).sum(axis=1))
        self.best = [(NONE, NONE, NONE)] * len(ids)
        self.place = {int(r): i for i, r in enumerate(rows)}

    def meet(self, bucket: Bucket) -> int:
        """Take the bucket's vectors in; the number of products computed."""
        if not len(bucket.ids) or not len(self.ids):
            return 0
        may = candidates(bucket, self.q, self.norms, self.bounds)
        for j in np.flatnonzero(np.isin(bucket.rows, self.rows)):
            may[self.place[int(bucket.rows[j])], j] = False  # a query's own row
        open_ = np.flatnonzero(may.any(axis=1))
        if not len(open_):
            return 0
        off = margin(self.norms, float(bucket.lengths[0]), self.q.shape[1], self.exact)
        dense = may.mean() >= FEW
        score = np.where(may[open_], self.q[open_] @ bucket.v.T, -np.inf) if dense else None
        for at, i in enumerate(open_):
            near = np.flatnonzero(may[i])
            s = score[at, near] if dense else bucket.v[near] @ self.q[i]
            reach = s >= self.bounds[i] - off[i]
            if not reach.any():
                continue
            near, s = near[reach], s[reach]
            if len(near) > self.k:
                reach = s >= np.partition(s, -self.k)[-self.k] - 2 * off[i]
                near, s = near[reach], s[reach]
            s = s.astype(np.int64) if self.exact else exact_products(bucket.whole[near], self.whole[i])
            ids, rows, s = (np.concatenate(x) for x in zip(self.best[i], (bucket.ids[near], bucket.rows[near], s)))
            first = np.lexsort((rows, ids, -s if self.exact else ~s))[: self.k]
            self.best[i] = ids[first], rows[first], s[first]
            if len(first) == self.k:
                self.bounds[i] = max(self.bounds[i], float(s[first[-1]]) - off[i])
        return int(may.sum())


def _pack(dims: int, per: int):
    """A sorted partition's vectors in images of at most ``per`` rows."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            for a in range(0, len(pdf), per):
                part = pdf.iloc[a : a + per]
                v = np.zeros((len(part), dims), "<i8")
                for i, x in enumerate(part["v"]):
                    v[i, : len(x)] = x
                yield pd.DataFrame([{"ids": part["id"].to_numpy("<i8").tobytes(), "rows": part["row"].to_numpy("<i8").tobytes(), "image": v.tobytes(), "longest": float(part["len"].max()), "n": len(part)}])

    return run


def _seed(top, dims: int, k: int, exact: bool):
    """Each query's bound from the longest bucket."""
    import pandas as pd

    def run(frames: Iterator) -> Iterator:
        _, rows, whole = top.value
        v = whole.astype(np.float64)
        longest = float(np.sqrt((v * v).sum(axis=1)).max())
        for pdf in frames:
            bounds, least = [], []
            for image, own in zip(pdf["image"], pdf["rows"]):
                q, mine = _unpack([image], dims).astype(np.float64), np.frombuffer(own, "<i8")
                norms = np.sqrt((q * q).sum(axis=1))
                scores = q @ v.T
                scores[mine[:, None] == rows[None, :]] = -np.inf
                got = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
                bounds.append((got - margin(norms, longest, dims, exact)).astype("<f8"))
                # the least bound per unit of length decides which buckets a block can skip
                least.append(float((bounds[-1] / np.maximum(norms, 1e-12)).min()))
            yield pdf.assign(bounds=[b.tobytes() for b in bounds], least=least)

    return run


def _cells(dims: int, k: int, exact: bool):
    """The best k per query of one cell: a group of query blocks and a group of
    buckets."""
    import pandas as pd

    def run(_key, blocks, buckets):
        opened = [Bucket(np.frombuffer(b.ids, "<i8"), np.frombuffer(b.rows, "<i8"), _unpack([b.image], dims)) for b in sorted(buckets.itertuples(), key=lambda b: -b.longest)]
        out = [np.zeros((5, 0), np.int64)]
        for b in blocks.itertuples():
            block = Block(np.frombuffer(b.ids, "<i8"), np.frombuffer(b.rows, "<i8"), _unpack([b.image], dims), np.frombuffer(b.bounds, "<f8"), k, exact)
            for bucket in opened:
                block.meet(bucket)
            many = [len(x[0]) for x in block.best]
            out.append(np.stack([np.repeat(block.rows, many), np.repeat(block.ids, many), *(np.concatenate(x) for x in zip(*block.best))]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["query_row", "query_id", "vec_id", "row", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, per_cell: int = 4, per_group: int = 4, image: int = IMAGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of
    floor(scale * x) for the rows where ``is_query(id)`` holds, against all rows."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    rows = rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "topk-vectors")
    spark = vectors.sparkSession
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    facts = rows.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if(is_query(F.col("id"))).alias("q"), F.max(largest).alias("most")).first()
    if not facts["n"] or not facts["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, facts["dims"])
    exact = dims * float(facts["most"] or 0) ** 2 < 2.0**53
    per = max(1, image // dims)
    shape = "ids binary, rows binary, image binary, longest double, n int"

    def images(df: DataFrame, many: int, name: str) -> DataFrame:
        by = df.repartitionByRange(max(1, -(-many // (per * 4))), F.col("len").desc(), "row").sortWithinPartitions(F.col("len").desc(), "row")
        return save(by.mapInPandas(_pack(dims, per), shape).withColumn("no", F.monotonically_increasing_id()), f"topk-{name}")

    buckets = images(rows, facts["n"], "buckets")
    blocks = images(rows.where(is_query(F.col("id"))), facts["q"], "queries")
    # the longest vectors, at most one image: what every query's first bound comes from
    first = buckets.orderBy(F.col("longest").desc(), "no").limit(1).collect()[0]
    top = spark.sparkContext.broadcast((np.frombuffer(first["ids"], "<i8"), np.frombuffer(first["rows"], "<i8"), _unpack([first["image"]], dims)))
    blocks = save(blocks.mapInPandas(_seed(top, dims, k, exact), shape + ", no long, bounds binary, least double"), "topk-bounded")

    # cells and groups, from a row per image: which group must meet which cell
    nth = lambda many: F.floor((F.row_number().over(Window.orderBy(F.col("longest").desc(), "no")) - 1) / many).cast("int")
    cells = save(buckets.select("no", "longest").withColumn("cell", nth(per_cell)), "topk-cells")
    groups = save(blocks.select("no", "longest", "least").withColumn("group", nth(per_group)), "topk-groups")
    reach = cells.groupBy("cell").agg(F.max("longest").alias("reach"))
    asked = groups.groupBy("group").agg(F.min("least").alias("least"))
    meet = save(asked.join(reach, F.col("reach") >= F.col("least") * (1 - 1e-9)).select("group", "cell"), "topk-meet")
    left = meet.join(blocks.join(groups.select("no", "group"), "no"), "group").select("group", "cell", "ids", "rows", "image", "bounds")
    right = meet.join(buckets.join(cells.select("no", "cell"), "no"), "cell").select(F.col("group").alias("g"), F.col("cell").alias("c"), "ids", "rows", "image", "longest")
    found = left.groupBy("group", "cell").cogroup(right.groupBy("g", "c")).applyInPandas(_cells(dims, k, exact), "query_row long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
