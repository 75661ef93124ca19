"""A Merkle manifest of a dataset with nested-interval labels.

A leaf is the digest of a row's columns.  Each source is a tree over its leaves
in the order of their ids; the sources' roots are the leaves of one more tree.
Every node carries the interval [lo, hi) of leaf ranks that it covers: a parent
covers its children's, so who stands above whom is told from intervals alone.
Levels are bucketed in bands of ``BAND``.  A band's nodes below one ancestor
are held in one row (``FAN`` ** ``BAND`` at most), and its levels are digested
there.  Going down, a containment join by bucket attaches to each such row what
stands above it; in the row, the siblings at a level are the parent's interval
less the node's own.  A proof is the digests of all siblings, left to right and
level by level; folding a leaf with them gives the root again.

Scale: texts are read once, for their digests, and not moved.  Ranks come from
a range partition by (source, id) and counts per partition, so a source of any
size is dealt to many tasks.  A level costs a third of the level below, a band
one shuffle; a path moves once per ``FAN`` ** ``BAND`` leaves.

Defined results: nulls, also of text, digest as ``-``, empty texts as ``0:``;
null sources are one tree, before all others; null ids come first in their
tree and are never tampered; rows of one id are in order of their digests;
repeated rows are leaves of their own, as equal rows with different proofs;
other columns are not read, whatever their names; an empty table has no root
and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, save

FAN, BAND = 3, 6
#: Rows of a range partition; rows of counts that may be broadcast.
ROWS, BROADCAST_ROWS = 50_000, 100_000
NOTHING = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the byte count, a colon, and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``lo``, their rank in their ``tree`` by ``order``, and
    ``n``, the tree's size."""
    many = rows.count()
    parts = max(1, -(-many // ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-many // 1000)))
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = save(dealt.withColumn("place", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("place", 33)
    counts = dealt.groupBy("tree", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = save(counts.select(F.col("tree").alias("t"), "part", "first", before.alias("before"), F.sum("many").over(Window.partitionBy("tree")).alias("n")), f"{name}-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts.hint("merge")
    out = dealt.join(counts, (F.col("tree") == F.col("t")) & (part == F.col("part")))
    return out.withColumn("lo", F.col("place") - F.col("first") + F.col("before")).drop("place", "t", "part", "first", "before")


def _above(level: Column) -> Column:
    """The digests of the parents of ``level``: every FAN consecutive ones."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), lambda p: F.sha2(F.array_join(F.slice(level, p * FAN + 1, FAN), "").cast("binary"), 256))


def bands(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Of ``leaves`` (tree, lo, n, digest, own): each band's rows (tree, bucket,
    lo, hi, n, kids, levels), and (tree, n, top) of every tree."""
    out, tops = [], None
    nodes = leaves.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", "digest", "own")
    while True:
        base = FAN ** (BAND * len(out))  # leaves that a node of this band's lowest level covers
        span = base * FAN**BAND
        kid = F.struct("lo", "hi", "digest", "own")
        rows = nodes.groupBy("tree", F.expr(f"lo div {span}L").alias("bucket"), "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        several = lambda j: F.col("n") > F.element_at(F.array(*[F.lit(base * FAN**i) for i in range(BAND)]), j + 1)
        levels = F.aggregate(F.sequence(F.lit(0), F.lit(BAND - 1)), F.array(F.col("kids.digest")), lambda acc, j: F.when(several(j), F.concat(acc, F.array(_above(F.element_at(acc, -1))))).otherwise(acc))
        rows = save(rows.select("tree", "bucket", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "n", "kids", levels.alias("levels")), f"{name}-band")
        out.append(rows)
        top = rows.select("tree", "bucket", "lo", "hi", "n", F.element_at("levels", -1)[0].alias("digest"))
        done = top.where(F.col("n") <= span).select("tree", "n", F.col("digest").alias("top"))
        tops = done if tops is None else tops.union(done)
        more = top.where(F.col("n") > span)
        if more.isEmpty():
            return out, tops
        nodes = more.withColumn("own", F.lit(None).cast("string")).drop("bucket")


def with_paths(rows: DataFrame, above: DataFrame, band: int, name: str) -> DataFrame:
    """Kids of a band's rows with their ``path``: the digests left and right of
    each ancestor-or-self within its parent, up to the root.  ``above`` has
    (tree, lo, hi, path, facts) of the intervals that the rows lie in."""
    base = FAN ** (BAND * band)
    span = base * FAN**BAND
    higher = above.select(F.col("tree").alias("t"), F.col("lo").alias("a"), F.col("hi").alias("z"), F.expr(f"lo div {span}L").alias("b"), F.col("path").alias("upper"), "facts")
    inside = (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("b")) & (F.col("a") <= F.col("lo")) & (F.col("hi") <= F.col("z"))
    both = rows.join(higher.hint("merge"), inside)

    def at(kid: Column, j: Column) -> Column:
        """Siblings at level j: the parent's interval less the node's own."""
        width = F.element_at(F.array(*[F.lit(FAN**i) for i in range(BAND)]), j + 1)
        node = F.floor((kid["lo"] - F.col("lo")) / (width * base)).cast("int")
        parent = node - node % FAN
        level = F.col("levels")[j]
        side = lambda start, many: F.array_join(F.slice(level, start + 1, many), "")
        return F.struct(side(parent, node - parent).alias("left"), side(node + 1, parent + FAN - 1 - node).alias("right"))

    steps = F.size("levels") - 1
    path = lambda kid: F.concat(F.when(steps > 0, F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda j: at(kid, j))).otherwise(F.array().cast(NOTHING)), F.col("upper"))
    kids = F.transform("kids", lambda kid: F.struct(F.col("tree").alias("tree"), kid["lo"].alias("lo"), kid["hi"].alias("hi"), kid["digest"].alias("digest"), kid["own"].alias("own"), path(kid).alias("path"), F.col("facts").alias("facts")))
    return both.select(F.inline(kids))


def paths(rows: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The leaves with their paths.  ``tops``: (tree, n, path, facts) of each
    tree's root."""
    whole = tops.select("tree", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), "path", "facts")
    kids = None
    for band in reversed(range(len(rows))):
        span = FAN ** (BAND * (band + 1))
        # trees that end in this band, and the intervals of the band above
        ended = whole.where((F.col("hi") <= span) & (F.col("hi") > (span // FAN**BAND if band else 0)))
        above = ended if kids is None else ended.union(kids.select("tree", "lo", "hi", "path", "facts"))
        kids = with_paths(rows[band], above, band, name)
    return kids


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """id, leaf, subroot, root, path, changed: each row's leaf with its proof.
    ``changed`` is the leaf as an audit finds it (see ``op12``): of every other
    row, by the id's crc32, the text has lost its line ends."""
    cut = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    hit = (crc_of_id(F.col(id_col)) % 2 == 0) & F.contains(F.col(text), F.lit("\n"))
    leaf = leaf_digest([F.col(c) for c in columns])
    other = leaf_digest([cut if c == text else F.col(c) for c in columns])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = save(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"), F.when(hit, other).alias("other")), "merkle-leaves")
    rows = ranked(rows, ["id", "digest"], "merkle")
    leaves = rows.select("tree", "lo", "n", "digest", F.struct("id", F.coalesce("other", "digest").alias("changed")).alias("own"))
    own, tops = bands(leaves, "merkle")
    tops = save(tops, "merkle-tops")
    upper = ranked(tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "top", F.col("n").alias("leaves")), ["source"], "merkle-root")
    upper = save(upper.select("tree", "lo", "n", F.col("top").alias("digest"), F.struct("source", "leaves").alias("own")), "merkle-upper")
    roots, root = bands(upper, "merkle-root")
    start = root.select("tree", "n", F.array().cast(NOTHING).alias("path"), F.struct(F.col("top").alias("root")).alias("facts"))
    sources = paths(roots, start, "merkle-root")
    start = save(sources.select(F.col("own.source").alias("tree"), F.col("own.leaves").alias("n"), "path", F.struct(F.col("facts.root").alias("root"), F.col("digest").alias("subroot")).alias("facts")), "merkle-sources")
    out = paths(own, start, "merkle")
    return out.select(F.col("own.id").alias(id_col), F.col("digest").alias("leaf"), "facts.subroot", "facts.root", "path", "own.changed")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def audit(docs: DataFrame, columns: list[str], id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    m = manifest(docs, columns, id_col, source, text)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    out = m.select(id_col, "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
