"""Reconciliation of a source and a target by key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.sources.scratch import stage


def recon_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """tbl, source_rows, target_rows, matches for named (source, target) pairs."""
    out = None
    for name, (s, t) in pairs.items():
        one = s.agg(F.count("*").alias("source_rows")).crossJoin(t.agg(F.count("*").alias("target_rows"))).select(F.lit(name).alias("tbl"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("matches"))
        out = one if out is None else out.union(one)
    return out


def matched(source: DataFrame, target: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """Rows of both sides by key: the keys, ``s`` and ``t`` (each side's row as
    a struct; null where it has none).  Null keys are equal to each other."""
    s = source.select(F.struct("*").alias("s"))
    t = target.select(F.struct("*").alias("t"))
    both = s.join(t, reduce(and_, [F.col(f"s.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys]), how)
    return both.select(*[F.when(F.col("s").isNull(), F.col(f"t.`{k}`")).otherwise(F.col(f"s.`{k}`")).alias(k) for k in keys], "s", "t")


def _hash(columns: list[str], seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *[F.struct(F.col(c), F.col(c).isNull()) for c in columns])


def recon_rows(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and state: missing, extra, different or equal.  Only keys and a
    64-bit hash of the other columns are shuffled; a null differs from a value.
    Null keys are equal to each other, so a row with one is matched like any."""
    both = matched(*[df.select(*keys, _hash(columns).alias("_h")) for df in (source, target)], keys)
    state = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s._h") == F.col("t._h"), "equal").otherwise("different")
    return both.select(*keys, state.alias("state"))


#: Children of a node of the tree of digests; nodes that may be broadcast.
FAN, BROADCAST_NODES = 256, 100_000


def recon_tree(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], levels: int = 2) -> DataFrame:
    """As ``recon_rows``, without the equal rows, by a tree of digests.

    Rows fall into FAN ** levels ranges of their key's hash.  Each side digests
    the top level's ranges (count, xor and sum of row hashes, combined before
    the shuffle); only within ranges whose digests differ are the next level's
    made, from a scan that keeps nothing else; and only rows of the last
    level's differing ranges are joined.  A level costs a scan of each side and
    shuffles FAN rows per task and differing range, so few changes move little.
    Where most ranges differ, ``recon_rows`` is the better way."""
    sides = []
    for df in (source, target):
        sides.append(df.withColumn("_k", F.xxhash64(F.lit(7), *[F.struct(F.col(k), F.col(k).isNull()) for k in keys])).withColumn("_h", _hash([*keys, *columns])))

    def node(level: int) -> Column:
        """A row's range at a level: the first bits of its key's hash."""
        return F.shiftrightunsigned("_k", 64 - 8 * level)

    def within(df: DataFrame, nodes: DataFrame | None, level: int) -> DataFrame:
        if nodes is None:
            return df
        few = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes.hint("merge")
        return df.join(few, node(level) == F.col("_node"), "left_semi")

    nodes = None
    for level in range(1, levels + 1):
        digests = []
        for df in sides:
            rows = within(df, nodes, level - 1).select(node(level).alias("n"), "_h")
            digests.append(rows.groupBy("n").agg(F.count("*").alias("c"), F.bit_xor("_h").alias("x"), F.sum(F.pmod(F.xxhash64("_h"), F.lit(2**31))).alias("a")))
        both = matched(*digests, ["n"])
        nodes = stage(both.where(~F.col("s").eqNullSafe(F.col("t"))).select(F.col("n").alias("_node")), "recon-nodes")
    rows = [within(df, nodes, levels) for df in sides]
    return recon_rows(*rows, keys, columns).where("state <> 'equal'")


def recon_collections(source: DataFrame, target: DataFrame, keys: list[str], column: str, one_sided: bool = False) -> DataFrame:
    """Keys of both sides whose collections differ as sorted values; with
    ``one_sided`` also the keys that one side lacks."""
    both = matched(*[df.select(*keys, F.array_sort(F.col(column)).alias("_v")) for df in (source, target)], keys, "full" if one_sided else "inner")
    return both.select(*keys, (~F.col("s").isNull().eqNullSafe(F.col("t").isNull()) | ~F.col("s._v").eqNullSafe(F.col("t._v"))).alias("differs"))


def recon_elements(source: DataFrame, target: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per key of either side whose collections differ: side (both, source or
    target) and the elements that only the source or only the target has."""
    both = matched(*[df.select(*keys, F.col(column).alias("_v")) for df in (source, target)], keys)
    side = F.when(F.col("t").isNull(), "source").when(F.col("s").isNull(), "target").otherwise("both")
    none = F.array().cast(source.schema[column].dataType)
    ours, theirs = (F.coalesce(F.col(f"{x}._v"), none) for x in ("s", "t"))
    out = both.select(*keys, side.alias("side"), F.array_sort(F.array_except(ours, theirs)).alias("only_source"), F.array_sort(F.array_except(theirs, ours)).alias("only_target"))
    return out.where((F.col("side") != "both") | (F.size("only_source") > 0) | (F.size("only_target") > 0))


def recon_static(source: DataFrame, target: DataFrame, partition: list[str], column: str) -> DataFrame:
    """Static values per partition that do not match."""
    both = matched(*[df.select(*partition, F.col(column).alias("_v")) for df in (source, target)], partition)
    out = both.select(*partition, F.col("s._v").alias("ours"), F.col("t._v").alias("theirs"))
    return out.where(~F.col("ours").eqNullSafe(F.col("theirs")))


def recon_ttl(source: DataFrame, target: DataFrame, keys: list[str], tolerance: int, one_sided: bool = False) -> DataFrame:
    """Keys of both sides and whether their expiries match within a tolerance;
    with ``one_sided`` also the keys that one side lacks, which do not match."""
    both = matched(*[df.select(*keys, "expiry") for df in (source, target)], keys, "full" if one_sided else "inner")
    lone = F.col("s").isNull() | F.col("t").isNull()
    both = both.select(*keys, F.col("s.expiry").alias("ours"), F.col("t.expiry").alias("theirs"), lone.alias("_lone"))
    ok = F.when(F.col("_lone"), F.lit(False)).when(F.col("ours").isNull() | F.col("theirs").isNull(), F.col("ours").eqNullSafe(F.col("theirs"))).otherwise(F.abs(F.col("ours") - F.col("theirs")) <= tolerance)
    return both.select(*keys, "ours", "theirs", ok.alias("ttl_ok"))


def spot_check(source: DataFrame, target: DataFrame, keys: list[str], sampled, columns: list[str]) -> DataFrame:
    """Sampled keys found on both sides, null keys included, with whether their
    columns agree."""
    names = list(dict.fromkeys([*keys, *columns]))
    both = matched(source.where(sampled).select(*names), target.select(*names), keys, "inner")
    same = reduce(and_, [F.col(f"s.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in columns], F.lit(True))
    return both.select(*keys, same.alias("same"))
