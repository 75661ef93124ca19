"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased; lines travel as 64-bit hashes of their keys.  Distinct hashes and
their document counts are dealt to shards.  Each shard builds a minimal
perfect hash: levels of bit arrays in which a hash owns a bit if no other of
its level falls there, ranked to a dense index.  The index leads to two
compact arrays, fingerprints and counts (one byte each up to the threshold).
Documents do not join the line table: their distinct hashes are dealt to the
shards, where each probes the arrays; what comes back is the set of frequent
hashes of each document.  A Bloom filter of the texts that have any tells most
other documents apart, whose texts are then not shuffled.

Scale: shards hold at most about ``per_shard`` hashes.  A shard whose probes
pass ``per_probe`` (a line that is in a third of all documents) is split by
document, and its arrays, which are small, are copied to each part.  The filter
takes 16 bits a text, between 2**16 and 2**27 (16 MB) in all: it is made by
partial aggregates and is the only thing that passes through the driver.
Beyond 8 million texts with frequent lines it lets more and more others pass,
which costs their shuffle and changes no result.

Defined results: a null or empty text is one empty line; empty keys are never
dropped; every row counts as a document, repeated rows too; columns of the
names n_lines, n_dropped and kept are replaced, others may have any names; an
empty table gives an empty result.  Two keys with one 64-bit hash would count as
one: among 10**9 distinct lines that is expected for 0.03 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, save

LEVELS, GAMMA = 24, 2.0
#: Probes of the Bloom filter, and the least and most bits it has.
BLOOM_PROBES, BLOOM_LEAST, BLOOM_MOST = 4, 1 << 16, 1 << 27


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def build(hashes: np.ndarray, counts: np.ndarray, threshold: int) -> dict[str, bytes]:
    """The arrays of one shard: bits (all levels, packed), sizes of levels,
    hashes that no level could place, fingerprints and capped counts."""
    left, bits, sizes = hashes.astype(np.uint64), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        m = max(64, int(GAMMA * len(left)))
        at = (_mix(left, level + 1) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        bits.append(alone)
        sizes.append(m)
        left = left[~alone[at]]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rest = np.sort(left)
    mph = {"bits": np.packbits(flat).tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "rest": rest.tobytes()}
    index = Probe(mph).index(hashes.astype(np.uint64))
    kind = np.uint8 if threshold < 256 else np.uint32
    prints, kept = np.zeros(len(hashes), np.uint16), np.zeros(len(hashes), kind)
    prints[index] = _fingerprint(hashes.astype(np.uint64))
    kept[index] = np.minimum(counts, threshold)
    return mph | {"prints": prints.tobytes(), "counts": kept.tobytes()}


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 77) >> np.uint64(48)).astype(np.uint16)


class Probe:
    """A shard's arrays, opened for lookups."""

    def __init__(self, blob: dict[str, bytes], threshold: int = 0) -> None:
        self.sizes = np.frombuffer(blob["sizes"], np.int64)
        total = int(self.sizes.sum())
        self.bits = np.unpackbits(np.frombuffer(blob["bits"], np.uint8), count=total).astype(bool) if total else np.zeros(0, bool)
        self.rank = np.concatenate([[0], np.cumsum(self.bits)])
        self.rest = np.frombuffer(blob["rest"], np.uint64)
        if "prints" in blob:
            self.prints = np.frombuffer(blob["prints"], np.uint16)
            self.counts = np.frombuffer(blob["counts"], np.uint8 if threshold < 256 else np.uint32)

    def index(self, h: np.ndarray) -> np.ndarray:
        """The dense index of each hash; -1 for one that is surely foreign."""
        out, open_, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, m in enumerate(self.sizes):
            at = base + (_mix(h[open_], level + 1) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + m
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h[open_]), len(self.rest) - 1)
            hit = self.rest[at] == h[open_]
            out[open_[hit]] = self.rank[-1] + at[hit]
        return out

    def count(self, h: np.ndarray) -> np.ndarray:
        """The capped count of each hash, 0 where the fingerprint differs."""
        at = self.index(h)
        known = at >= 0
        known[known] = self.prints[at[known]] == _fingerprint(h[known])
        out = np.zeros(len(h), np.int64)
        out[known] = self.counts[at[known]]
        return out


def _build_shards(threshold: int):
    import pandas as pd

    def run(pdf):
        blob = build(pdf["h"].to_numpy().view(np.uint64), pdf["n"].to_numpy(), threshold)
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0]} | blob])

    return run


def _probe(threshold: int):
    import pandas as pd

    def run(_key, lines, blobs):
        if not len(lines) or not len(blobs):
            return pd.DataFrame({"tid": [], "h": []}).astype("int64")
        counts = Probe(blobs.iloc[0].to_dict(), threshold).count(lines["h"].to_numpy().view(np.uint64))
        return lines.loc[counts >= threshold, ["tid", "h"]]

    return run


def _lost():
    """Which of a document's line hashes are among those gone: one sorted
    lookup per document, whatever the number of either."""
    from pyspark.sql.functions import pandas_udf

    def run(each, gone):
        import pandas as pd

        return pd.Series([None if a is None or b is None else np.isin(a, b).tolist() for a, b in zip(each, gone)], dtype=object)

    return pandas_udf(run, "array<boolean>")


def bloom(ids: DataFrame, least: int = BLOOM_LEAST, most: int = BLOOM_MOST) -> np.ndarray:
    """A Bloom filter of the column ``tid`` of distinct 64-bit hashes, as words
    of 64 bits.  A hash's halves lead to its bits."""
    bits = least
    while bits < min(most, 16 * ids.count()):
        bits *= 2
    steps = F.explode(F.sequence(F.lit(0), F.lit(BLOOM_PROBES - 1)))
    at = (F.col("tid").bitwiseAND(0x7FFFFFFF) + F.col("i") * F.shiftrightunsigned("tid", 33)).bitwiseAND(bits - 1)
    each = ids.select("tid", steps.alias("i")).select(at.alias("at"))
    words = each.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def in_bloom(words: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never false for one that is."""
    low, high = tid & 0x7FFFFFFF, (tid.view(np.uint64) >> np.uint64(33)).astype(np.int64)
    out = np.ones(len(tid), bool)
    for i in range(BLOOM_PROBES):
        at = (low + i * high) & (64 * len(words) - 1)
        out &= (words[at >> 6] >> (at & 63)) & 1 == 1
    return out


def _may_lose(spark, words: np.ndarray):
    from pyspark.sql.functions import pandas_udf

    sent = spark.sparkContext.broadcast(words)

    def run(tids):
        import pandas as pd

        return pd.Series(in_bloom(sent.value, tids.to_numpy()))

    return pandas_udf(run, "boolean")


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(ASCII_SPACE)))


def frequent_lines(texts: DataFrame, min_docs: int, per_shard: int = 500_000, per_probe: int = 1_000_000) -> DataFrame:
    """(tid, gone): for each text of ``texts`` (tid, copies, hashes: distinct)
    with any, the hashes that at least ``min_docs`` documents have."""
    lines = texts.select("tid", "copies", F.explode("hashes").alias("h"))
    counts = save(lines.groupBy("h").agg(F.sum("copies").alias("n"), F.count("*").alias("texts")), "line-counts")
    shards = max(1, -(-counts.count() // per_shard))
    by = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    blobs = counts.withColumn("shard", by).groupBy("shard").applyInPandas(_build_shards(min_docs), "shard int, bits binary, sizes binary, rest binary, prints binary, counts binary")
    blobs = save(blobs, "line-arrays")
    # how many parts each shard's probes are dealt to
    parts = counts.groupBy(by.alias("shard")).agg(F.ceil(F.sum("texts") / per_probe).cast("int").alias("parts"))
    parts = save(parts, "line-parts")
    dealt = lines.withColumn("shard", by).join(parts, "shard").select("tid", "h", "shard", F.pmod(F.xxhash64("tid"), "parts").cast("int").alias("part"))
    copies = blobs.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(_probe(min_docs), "tid long, h long")
    return found.groupBy("tid").agg(F.collect_set("h").alias("gone"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", min_chars: int = 1, **kw) -> DataFrame:
    """``docs`` with the columns n_lines, n_dropped and ``kept``, the text
    without lines whose key (of ``min_chars`` or more) is in ``min_docs`` or
    more documents.

    Equal texts are counted first and probed once.  A text is known by its
    64-bit hash: should two texts share one, they would share their sets of
    frequent lines, which changes neither's result.
    """
    tid = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keys = F.filter(line_keys(F.col(text)), lambda k: F.char_length(k) >= min_chars)
    hashes = docs.select(tid.alias("tid"), F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k))).alias("hashes"))
    texts = save(hashes.groupBy("tid", "hashes").agg(F.count("*").alias("copies")), "line-texts")
    gone = save(frequent_lines(texts, min_docs, **kw), "line-frequent").withColumnRenamed("tid", "_tid")
    may_lose = _may_lose(docs.sparkSession, bloom(gone.select(F.col("_tid").alias("tid"))))(F.col("tid"))
    rows, body = docs.select(F.struct("*").alias("doc"), tid.alias("tid")), F.col("doc")[text]
    lines = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    # always by shuffle: the plan is then the same for every size of ``gone``
    both = rows.where(may_lose).join(gone.hint("merge"), F.col("tid") == F.col("_tid"), "left")
    # only of documents that lose lines; keys below min_chars are in no ``gone``
    each = F.when(F.col("gone").isNotNull(), F.transform(line_keys(body), lambda k: F.xxhash64(k)))
    both = both.withColumn("_lost", _lost()(each, F.col("gone")))
    kept = F.when(F.col("_lost").isNull(), lines).otherwise(F.filter(lines, lambda _, i: ~F.get("_lost", i)))
    both = both.select("doc", kept.alias("_kept"))
    both = both.select("doc", (F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("kept"))
    whole = rows.where(~may_lose).select("doc", F.lit(0).cast("long").alias("n_dropped"), F.coalesce(body, F.lit("")).alias("kept"))
    out = both.union(whole).withColumn("n_lines", F.size(lines).cast("long"))
    new = ["n_lines", "n_dropped", "kept"]
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in new], *new)
