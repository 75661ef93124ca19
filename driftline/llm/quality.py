"""Quality scores from a byte-level convolutional network in numpy.

Bytes are embedded, filters of eight bytes run over the whole document in
steps of four, and each filter's highest response is kept per chunk of 256
bytes; chunks overlap by half.  A document's features are the means of its
chunks' pooled responses, and a logistic unit combines them into one
probability.  Embedding, filters and unit are learned together with Adam.

Scale: the network is fitted on the driver on whole texts of labelled rows:
per class at most ``sample_rows`` rows of ``sample_bytes`` bytes together, by
hash of the id.  Rows of more than a 64th of those bytes come after all others,
and the first row is always taken.  The weights are a few kilobytes.  Scoring
reads every byte of every text once, in bounded slabs, without a shuffle.

Learned weights are rounded to 64ths, so that every sum of a response is exact
in single precision: a text's score does not depend on its neighbours.

Defined results: a null text is scored as an empty one (one chunk of padding);
labels that are null, or of ids that no document has, are ignored, and take no
place in the sample; rows with a null id are neither learned from nor held out;
without labels every score is 0.5, with one class its label; repeated rows get
equal scores; other columns are not read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, ship
from .language_id import slabs, text_buffer

GROUP, HALF, DIM, FILTERS = 4, 32, 6, 24  # bytes per step, steps per half chunk
SLAB = 1 << 20


class Network:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.first = r.normal(0, 0.25, (GROUP * DIM, FILTERS)).astype(np.float32)
        self.second = r.normal(0, 0.25, (GROUP * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = r.normal(0, 0.1, FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.bias, self.weight, self.offset]

    def features(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean pooled responses of each text."""
        step = GROUP * HALF
        sizes = np.diff(starts)
        halves = np.maximum(1, -(-sizes // step))
        at = np.concatenate([[0], np.cumsum(halves)])
        padded = np.zeros(int(at[-1]) * step, np.uint8)
        shift = np.repeat(at[:-1] * step - (starts[:-1] - starts[0]), sizes)
        padded[np.arange(len(data)) + shift] = data
        groups = self.embed[padded].reshape(-1, GROUP * DIM)
        z = groups @ self.first
        ahead = groups @ self.second
        z[:-1] += ahead[1:]
        ends = at[1:] * HALF - 1
        z[ends[:-1]] -= ahead[ends[:-1] + 1]  # what follows a text's end is padding, not the next text
        padding = np.tile(self.embed[0], GROUP) @ self.second
        z[ends] += padding
        pooled = np.maximum(z.reshape(-1, HALF, FILTERS).max(axis=1) + self.bias, 0)
        both = pooled.copy()
        both[:-1] = np.maximum(pooled[:-1], pooled[1:])  # a chunk is two halves
        many = halves > 1
        skip = np.zeros(len(pooled), bool)
        skip[at[1:][many] - 1] = True  # the last half starts no chunk
        both[at[1:] - 1] = pooled[at[1:] - 1]
        both[skip] = 0
        return np.add.reduceat(both.astype(np.float64), at[:-1], axis=0) / np.maximum(1, halves - 1)[:, None]

    def round(self) -> Network:
        """Weights as 64ths from -4 to 4: responses are then sums of 48 products
        that single precision holds exactly, in whatever order they are added."""
        for part in (self.embed, self.first, self.second, self.bias):
            part[...] = np.clip(np.round(part * 64) / 64, -4, 4)
        return self

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        logit = (self.features(data, starts) * self.weight.astype(np.float64)).sum(axis=1) + float(self.offset[0])
        return 1 / (1 + np.exp(-logit))


def fit(texts: list[bytes], labels: list[int], steps: int = 500, batch: int = 48, chunks: int = 8, rate: float = 4e-3, seed: int = 7) -> Network:
    """Train on random chunks of each text; classes weigh the same."""
    net, r = Network(seed), np.random.default_rng(seed)
    size = GROUP * HALF * 2
    y = np.array(labels, np.float32)
    arrays = [np.frombuffer(t, np.uint8) if t else np.zeros(1, np.uint8) for t in texts]
    of_class = [np.flatnonzero(y == c) for c in (0, 1)]
    m = [np.zeros_like(p) for p in net.parts()]
    v = [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(c, batch // 2) for c in of_class])
        x = np.zeros((batch, chunks, size + GROUP), np.uint8)
        for i, p in enumerate(pick):
            a = arrays[p]
            for j, s in enumerate(r.integers(0, max(1, len(a) - size + 1), chunks)):
                piece = a[s - s % GROUP :][: size + GROUP]
                x[i, j, : len(piece)] = piece
        n = batch * chunks
        groups = net.embed[x.reshape(n, -1)].reshape(n, 2 * HALF + 1, GROUP * DIM)
        z = groups[:, :-1] @ net.first + groups[:, 1:] @ net.second + net.bias
        best = z.argmax(axis=1)
        top = np.take_along_axis(z, best[:, None], axis=1)[:, 0]
        pooled = np.maximum(top, 0)
        mean = pooled.reshape(batch, chunks, FILTERS).mean(axis=1)
        p = 1 / (1 + np.exp(-(mean @ net.weight + net.offset)))
        d = ((p - y[pick]) / batch).astype(np.float32)
        d_pooled = np.repeat(d[:, None] * net.weight, chunks, axis=0) / chunks * (top > 0)
        d_z = np.zeros_like(z)
        np.put_along_axis(d_z, best[:, None], d_pooled[:, None], axis=1)
        flat = d_z.reshape(-1, FILTERS)
        g_first = groups[:, :-1].reshape(-1, GROUP * DIM).T @ flat
        g_second = groups[:, 1:].reshape(-1, GROUP * DIM).T @ flat
        d_groups = np.zeros_like(groups)
        d_groups[:, :-1] += d_z @ net.first.T
        d_groups[:, 1:] += d_z @ net.second.T
        d_bytes = d_groups.reshape(-1, DIM)
        g_embed = np.stack([np.bincount(x.ravel(), weights=d_bytes[:, k], minlength=256) for k in range(DIM)], axis=1)
        grads = [g_embed, g_first, g_second, d_pooled.sum(axis=0), d @ mean + 1e-4 * net.weight, d.sum(keepdims=True)]
        for k, (part, g) in enumerate(zip(net.parts(), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            pace = rate * (1 - step / (steps + 1))
            part -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net.round()


def sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, sample_bytes: int) -> list[tuple[bytes, int]]:
    """Whole texts of labelled rows of ``docs`` (id, text), bounded per class
    by rows and bytes.  Only ids, sizes and hashes are shuffled."""
    slim = docs.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("th"))
    out = []
    for c in (0, 1):
        ids = labels.where(F.col(label) == c).select("id").distinct()
        order = [F.col("size") > sample_bytes // 64, F.xxhash64("id"), F.col("id"), F.col("th")]
        first = slim.join(ids, "id").distinct().orderBy(*order).limit(sample_rows)  # at most sample_rows rows from here on
        upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = first.withColumn("upto", upto).where((F.col("upto") <= sample_bytes) | (F.col("upto") == F.col("size")))
        picked = first.select(F.col("id").alias("_id"), F.col("th").alias("_th"))
        rows = docs.join(F.broadcast(picked), (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th"))).dropDuplicates(["_id", "_th"])
        out += [((r["text"] or "").encode(), c) for r in rows.orderBy(F.xxhash64("_id"), "_id", "_th").collect()]
    return out


def _scorer(parts, constant, text: str, keep: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        net = None
        if constant is None:
            net = Network()
            net.embed, net.first, net.second, net.bias, net.weight, net.offset = parts
        for batch in batches:
            data, offsets = text_buffer(batch, text)
            scores = np.full(batch.num_rows, 0.0 if constant is None else constant)
            if net is not None:
                for a, b in slabs(offsets, SLAB):
                    scores[a:b] = net.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", fold: int = 5, held: int = 0, threshold: float = 0.3, sample_rows: int = 1500, sample_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, held_out, score, predicted.  Rows whose id's
    crc32 modulo ``fold`` is ``held`` are never learned from."""
    ship(docs.sparkSession)
    part = lambda c: F.pmod(crc_of_id(F.col(c)), F.lit(fold))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = sample(slim, labels.where(part(id_col) != held).select(F.col(id_col).alias("id"), F.col(label).alias("y")), "y", sample_rows, sample_bytes)
    seen = {y for _, y in rows}
    constant = None if len(seen) == 2 else float(min(seen)) if seen else 0.5
    parts = fit([t for t, _ in rows], [y for _, y in rows]).parts() if constant is None else None
    out = slim.mapInArrow(_scorer(parts, constant, "text", ["id"]), f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(part("id") == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
