"""Self-join on the Jaccard similarity of word shingles by chosen paths.

Each distinct sequence of words is one set (its copies are counted, not
joined) with a signature of ``T`` minima.  A run starts with all sets in one
node.  A node picks ``CHILDREN`` positions of the signature by its own hash,
and each set goes to one child per position, with those that share the token
there; no position is used twice on a path.  Children of at most ``LEAF`` sets
are compared by brute force; larger ones split again.  A large node first
compares all its sets with a pivot, its smallest set number.  Sets somewhat
near the pivot are linked to it; those nearer still need not go on, because
whatever is similar to them is linked to the pivot too.  A node whose sets were
all linked to one pivot on the way is settled and goes no further.  Sets that
have shared ``LEVELS`` tokens are all linked to their pivot.  Runs repeat until
a pair at the threshold is missed less often than the target recall allows.

What is found this way are candidates, and every link points to a smaller set
number.  Their components are then verified on exact shingle sets, so that the
links that are counted are exact and complete.  A component of at most
``BLOCK`` sets is one cell, which names its classes at once.  A larger one is
dealt to cells of two blocks, and the cells' classes are merged.

Scale: large nodes move as (node, set) pairs; nodes of one set are dropped at
once.  No pairs are written: a leaf returns a spanning forest, and a cell
returns each member's number of links and its smallest linked member.  Cells
hold at most about two times ``BLOCK`` sets, whatever the size of the
component, and run as separate tasks.  Counting the links of a class of m
different texts takes m * m / 2 comparisons, spread over those cells (copies
take none).  Texts of members are found by a broadcast of at most
``BROADCAST_ROWS`` members, by a shuffle beyond that.

Defined results: texts without words are not similar to anything, copies
included; texts of 1 to k - 1 words have one shingle; null and empty texts are
wordless; repeated rows are copies, also if their ids are null; a class is
named by its smallest id that is not null; rows of one id with different texts
are different documents; other columns of ``docs`` are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import shingles as S
from .common import drop, packed, save, ship
from .language_id import slabs, text_buffer

T, CHILDREN, LEAF, BLOCK, LEVELS = 64, 2, 1024, 1024, 12
#: Rows that a task gets at least, by what they cost: moved, compared in leaves,
#: compared exactly.
MOVED, COMPARED, VERIFIED = 100_000, 20_000, 2_000
#: Members of candidate components that may be broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000
#: How far below the similarity the agreement of two signatures may lie: in a
#: leaf; for a link to a pivot; for a set that the pivot's links settle.  The
#: last two differ by the largest distance of a similar pair (Jaccard distance
#: obeys the triangle inequality) and a standard error of agreement.
NEAR, PIVOT_LINK, PIVOT_DONE = 0.22, 0.50, 0.24
SLAB = 2 << 20


def runs_needed(similarity: float, recall: float) -> int:
    """Runs after which a pair at ``similarity`` was missed with a probability
    of at most 1 - ``recall``: a pair is lost in a run if the branching of the
    paths that it shares dies out."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similarity + similarity * lost) ** CHILDREN
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def _sketch(keep: str, text: str, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffer(batch, text)
            for a, b in slabs(offsets, SLAB):
                words, first = S.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sh, at = S.shingle_hashes(words, first, k)
                c1, c2 = S.sequence_hashes(words, first)
                sizes = [len(x) for x in S.distinct(sh, at)]
                sig = S.signatures(sh, at, T)
                own = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in (keep, "th")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(c1), pa.array(c2), pa.array(sizes, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "th", "c1", "c2", "n", "sig"])

    return run


def _column(batch, name: str, kind) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(kind)


def _sigs(batch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), np.uint32).reshape(-1, T)


def children(nodes: np.ndarray, used: np.ndarray, sig: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of CHILDREN positions, the keys of the nodes that sets go to
    from ``nodes``, and the positions used so far (a bit for each)."""
    out = []
    taken = used.copy()
    for c in range(CHILDREN):
        at = S.mix64(nodes + np.uint64(c + 1)) % np.uint64(T)
        while (busy := (taken >> at) & np.uint64(1) == 1).any():
            at = np.where(busy, (at + np.uint64(1)) % np.uint64(T), at)
        taken = taken | (np.uint64(1) << at)
        token = sig[np.arange(len(nodes)), at.astype(np.int64)].astype(np.uint64)
        out.append((S.mix64(S.mix64(nodes) ^ (token + (at << np.uint64(33)))), used | (np.uint64(1) << at)))
    return out


def _roots(runs: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rid, sig = _column(batch, "rid", np.int64), _sigs(batch, "sig")
            for r in range(runs):
                root = S.mix64(np.array([r + 1], np.uint64))[0]
                for keys, used in children(np.full(len(rid), root), np.zeros(len(rid), np.uint64), sig):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(used.view(np.int64)), pa.array(rid)], names=["key", "used", "rid"])

    return run


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` items is linked to by (i, j)."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == was).all():
            return label


def _leaves(similarity: float):
    """Rows (key, rid, n, sig) sorted by key: edges (src, dst) of a spanning
    forest of each key's near sets."""

    def near(key, rid, n, sig):
        i_all, j_all = [], []
        for d in range(1, len(key)):
            i = np.flatnonzero(key[:-d] == key[d:])
            if not len(i):
                break
            j = i + d
            fit = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[fit], j[fit]
            for a in range(0, len(i), 50_000):
                b = slice(a, a + 50_000)
                close = (sig[i[b]] == sig[j[b]]).mean(axis=1) >= similarity - NEAR
                i_all.append(i[b][close])
                j_all.append(j[b][close])
        if not i_all:
            return None
        label = forest(len(key), np.concatenate(i_all), np.concatenate(j_all))
        moved = np.flatnonzero(label != np.arange(len(key)))
        return (rid[moved], rid[label[moved]]) if len(moved) else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            now = (_column(batch, "key", np.int64), _column(batch, "rid", np.int64), _column(batch, "n", np.int64), _sigs(batch, "sig"))
            now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0  # the last key may go on
            held = tuple(x[last:] for x in now)
            got = near(*(x[:last] for x in now))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["src", "dst"])
        if held is not None and (got := near(*held)):
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["src", "dst"])

    return run


def _split(similarity: float, level: int):
    """Members of large nodes with the node's pivot: links to the pivot
    (key null) and the members' places in the node's children (dst null)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, last = ["key", "used", "linked", "rid", "dst", "n", "sig"], level == LEVELS - 1
        for batch in batches:
            key, used, linked, rid, pivot = (_column(batch, c, np.int64) for c in ("key", "used", "linked", "rid", "pivot"))
            sig = _sigs(batch, "sig")
            same = (sig == _sigs(batch, "pivot_sig")).mean(axis=1)
            link = (rid != pivot) & (last | (same >= similarity - PIVOT_LINK))
            none = pa.nulls(int(link.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(rid[link]), pa.array(pivot[link]), pa.nulls(len(none), pa.int32()), pa.nulls(len(none), pa.binary())], names=names)
            linked = linked | (link.astype(np.int64) << level)
            on = (same < similarity - PIVOT_DONE) & (rid != pivot)
            if last or not on.any():
                continue
            none = pa.nulls(int(on.sum()), pa.int64())
            own = [batch.column(batch.schema.get_field_index(c)).filter(pa.array(on)) for c in ("n", "sig")]
            for keys, now in children(key[on].view(np.uint64), used[on].view(np.uint64), sig[on]):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(now.view(np.int64)), pa.array(linked[on]), pa.array(rid[on]), none, *own], names=names)

    return run


def candidate_edges(sets: DataFrame, similarity: float, runs: int) -> list[DataFrame]:
    """Tables of (src, dst) among ``sets`` (rid, n, sig), dst being smaller: a
    forest whose components hold every pair that a run brought to one leaf or
    pivot."""
    slim = sets.select("rid", "n", "sig")
    at = save(slim.mapInArrow(_roots(runs), "key long, used long, rid long").withColumn("linked", F.lit(0).cast("long")), "join-nodes")
    edges, done = [], [at]
    for level in range(LEVELS):
        rows = at.count()
        nodes = at.groupBy("key").agg(F.count("*").alias("many"), F.min("rid").alias("pivot"), F.bit_and("linked").alias("settled"))
        nodes = save(packed(nodes.where("many > 1 and settled = 0").drop("settled"), rows, MOVED), "join-sizes")
        members = at.join(nodes.hint("merge"), "key")
        if level == 0:  # later levels carry their signatures along
            members = members.join(slim.hint("merge"), "rid")
        members = save(packed(members.select("key", "used", "linked", "rid", "n", "sig", "many", "pivot"), rows, MOVED), "join-members")
        drop(*done)
        small, large = members.where(F.col("many") <= LEAF), members.where(F.col("many") > LEAF)
        leaf = packed(small.select("key", "rid", "n", "sig").repartition("key"), small.count(), COMPARED).sortWithinPartitions("key", "rid")
        edges.append(save(leaf.mapInArrow(_leaves(similarity), "src long, dst long"), "join-edges"))
        pivots = save(large.where("rid = pivot").select(F.col("key").alias("k"), F.col("sig").alias("pivot_sig")), "join-pivots")
        if pivots.isEmpty():
            break
        both = large.join(pivots, F.col("key") == F.col("k")).select("key", "used", "linked", "rid", "pivot", "n", "sig", "pivot_sig")
        split = save(both.mapInArrow(_split(similarity, level), "key long, used long, linked long, rid long, dst long, n int, sig binary"), "join-split")
        edges.append(split.where("dst is not null").select(F.col("rid").alias("src"), "dst"))
        at, done = split.where("key is not null").drop("dst"), [nodes, members, pivots]
    return edges


def _hook(batches: Iterator) -> Iterator:
    """Rows (src, dst) sorted by both: each src with its smallest dst, and its
    other ones hung below that (``more``)."""
    import pyarrow as pa

    last, low, seen = None, 0, None
    for batch in batches:
        src, dst = _column(batch, "src", np.int64), _column(batch, "dst", np.int64)
        if not len(src):
            continue
        new = np.concatenate([[last is None or src[0] != last], src[1:] != src[:-1]])
        again = np.concatenate([[not new[0] and dst[0] == seen], ~new[1:] & (dst[1:] == dst[:-1])])
        firsts = np.concatenate([[low], dst[new]])
        least = firsts[np.cumsum(new)]
        more = ~new & ~again & (dst != least)
        last, low, seen = src[-1], least[-1], dst[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([src[new], dst[more]])), pa.array(np.concatenate([dst[new], least[more]])), pa.array(np.repeat([False, True], [new.sum(), more.sum()]))],
            names=["src", "dst", "more"],
        )


def roots_of(edges: DataFrame, name: str) -> DataFrame:
    """(src, dst) for links that all point to smaller numbers: each src with
    the smallest node of its component.

    Hooking hangs all but a node's smallest parent below that one, until each
    node has one parent; then parents are doubled until they are roots.  A node
    has as many rows as different parents, and a hub is only ever a dst, whose
    rows Spark can split.
    """
    now = edges
    while True:
        dealt = packed(now.select("src", "dst").repartition("src"), now.count(), MOVED).sortWithinPartitions("src", "dst")
        now = save(dealt.mapInArrow(_hook, "src long, dst long, more boolean"), f"{name}-hooks")
        if now.where("more").isEmpty():
            break
    rows = now.count()
    while True:
        above = now.select(F.col("src").alias("mid"), F.col("dst").alias("top"))
        risen = now.select("src", "dst").join(above, F.col("dst") == F.col("mid"), "left").select("src", F.coalesce("top", "dst").alias("dst"), F.col("top").isNotNull().alias("more"))
        now = save(packed(risen, rows, MOVED), f"{name}-roots")
        if now.where("more").isEmpty():
            return now.select("src", "dst")


#: What a candidate component's member carries to its cells.
MEMBER = ("comp", "rid", "copies", "blocks", "c1", "c2", "rep", "rep_th")


def _exact_sets(k: int):
    """Candidates' texts: their exact shingle sets, if the text is the set's."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffer(batch, "text")
            w1, w2 = _column(batch, "c1", np.int64), _column(batch, "c2", np.int64)
            for a, b in slabs(offsets, SLAB):
                words, first = S.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                c1, c2 = S.sequence_hashes(words, first)
                sh = S.distinct(*S.shingle_hashes(words, first, k))
                own = np.flatnonzero((c1 == w1[a:b]) & (c2 == w2[a:b]))
                cols = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a).take(pa.array(own)) for c in MEMBER]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([sh[i].tobytes() for i in own], pa.binary())], names=[*MEMBER, "shingles"])

    return run


def overlaps(rows: list[np.ndarray], others: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of ``rows`` with ``others``, from products of
    0/1 matrices over the shingles that both sides have."""
    m = len(rows)
    sets = rows if others is rows else [*rows, *others]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    code = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1
    shared = np.bincount(code) > 1
    if others is not rows:
        shared = (np.bincount(code, weights=owner < m) > 0) & (np.bincount(code, weights=owner >= m) > 0)
    keep = shared[code]
    code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    out = np.zeros((m, len(others)), np.float32)  # whole numbers below 2**24, so exact
    for a in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(code, [a, a + columns])
        x = np.zeros((len(sets), min(columns, int(shared.sum()) - a)), np.float32)
        x[owner[lo:hi], code[lo:hi] - a] = 1
        out += x @ x.T if others is rows else x[:m] @ x[m:].T
    return out


def links_in_cell(rid, copies, block, sets, similarity: float, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each member's linked copies and smallest linked set; with ``cross`` only
    pairs of members of different blocks are compared.  Members are in order of
    ``rid``."""
    groups = [np.flatnonzero(block == b) for b in np.unique(block)] if cross else [np.arange(len(rid))]
    links, label = np.zeros(len(rid)), rid
    if len(groups) == 2 or not cross:
        mine, theirs = groups[0], groups[-1]
        first = [sets[i] for i in mine]
        second = [sets[i] for i in theirs] if cross else first
        both = overlaps(first, second)
        near = both >= similarity * (np.array([len(s) for s in first])[:, None] + np.array([len(s) for s in second])[None, :] - both) - 1e-9
        if not cross:
            np.fill_diagonal(near, False)
        links[mine] += near @ copies[theirs]
        if cross:
            links[theirs] += near.T @ copies[mine]
        i, j = np.nonzero(near)
        label = rid[forest(len(rid), mine[i], theirs[j])]
    return links, label


def _verify(similarity: float, kind):
    """Rows sorted by cell (comp, i, j): one row per member and cell.  A
    component of one cell has its classes named (``name``) and knows the member
    that names each (``best``)."""

    def cell(rows):
        first = {}
        for r in rows:
            first.setdefault(r[1], r)  # repeated rows of one set
        rows = [first[k] for k in sorted(first)]
        rid, copies, block = (np.array([r[c] for r in rows]) for c in (1, 2, 3))
        (_, i, j), one = rows[0][0], rows[0][8] == 1
        links, label = links_in_cell(rid, copies.astype(np.float64), block, [np.frombuffer(r[9], np.uint64) for r in rows], similarity, i != j)
        first = {}  # of each class, the member that names it
        for at, r in zip(label.tolist() if one else [], rows):
            if at not in first or (r[6] is None, r[6], r[7]) < (first[at][6] is None, first[at][6], first[at][7]):
                first[at] = r
        out = []
        for r, at, n in zip(rows, label.tolist(), links.tolist()):
            described = (r[c] for c in (4, 5, 6, 7, 2)) if i == j else (None,) * 5
            out.append((r[1], at, int(n), first[at][6] if one else None, one and first[at] is r, one, *described))
        return out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("rid", pa.int64()), ("label", pa.int64()), ("links", pa.int64()), ("name", kind), ("best", pa.bool_()), ("one", pa.bool_()), ("c1", pa.int64()), ("c2", pa.int64()), ("rep", kind), ("rep_th", pa.int64()), ("copies", pa.int64())])
        held, out = [], []

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("comp", "i", "j", "rid", "copies", "block", "c1", "c2", "rep", "rep_th", "blocks", "shingles")]
            for comp, i, j, *rest in zip(*cols):
                row = ((comp, i, j), *rest)
                if held and held[0][0] != row[0]:
                    out += cell(held)
                    held = []
                    if len(out) >= 5_000:
                        yield batch_of(out)
                        out = []
                held.append(row)
        if held:
            out += cell(held)
        if out:
            yield batch_of(out)

    return run


def _named(more: DataFrame) -> DataFrame:
    """Classes of the components that were dealt to several cells."""
    rows = more.count()
    of_set = more.groupBy("rid").agg(F.sum("links").alias("links"), *[F.max(c).alias(c) for c in ("c1", "c2", "rep", "rep_th", "copies")])
    of_set = save(packed(of_set, rows, MOVED), "join-sums")
    roots = roots_of(more.where("label <> rid").select(F.col("rid").alias("src"), F.col("label").alias("dst")), "class")
    rooted = of_set.join(roots, F.col("rid") == F.col("src"), "left").withColumn("root", F.coalesce("dst", "rid")).drop("src", "dst")
    rooted = save(packed(rooted, rows, MOVED), "join-rooted")
    own = F.struct(F.col("rep").isNull(), "rep", "rep_th")
    first = save(packed(rooted.groupBy(F.col("root").alias("r")).agg(F.min(own).alias("first")), rows, MOVED), "join-names")
    return rooted.join(first, F.col("root") == F.col("r")).select("*", F.col("first.rep").alias("name"), (own == F.col("first")).alias("best"))


def _classes(docs: DataFrame, k: int, similarity: float, recall: float, id_col: str, text: str) -> DataFrame:
    """id, th (hash of the text), class_id, n_links, and whether the row is the
    first of its class, for each document."""
    ship(docs.sparkSession)  # before the first Python function of the plan is made
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    kind = docs.schema[id_col].dataType
    marks = save(slim.mapInArrow(_sketch("id", "text", k), f"id {kind.simpleString()}, th long, c1 long, c2 long, n int, sig binary"), "join-marks")
    sets = marks.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = save(packed(sets, marks.count(), MOVED // 4).withColumn("rid", F.monotonically_increasing_id()), "join-sets")
    sets = sets.select("c1", "c2", "copies", "n", "sig", "rid", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th"))

    every = None
    for e in candidate_edges(sets, similarity, runs_needed(similarity, recall)):
        every = e if every is None else every.union(e)
    roots = roots_of(every, "join")
    comps = roots.select(F.col("src").alias("rid"), F.col("dst").alias("comp")).union(roots.select(F.col("dst").alias("rid"), F.col("dst").alias("comp")).distinct())
    rows = roots.count()
    sizes = roots.groupBy(F.col("dst").alias("large")).agg(F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    sizes = save(packed(sizes, rows, MOVED), "join-blocks")
    members = comps.join(sets.select("rid", "rep", "rep_th", "c1", "c2", "copies").hint("merge"), "rid")
    members = members.join(sizes, F.col("comp") == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = save(packed(members.select(*MEMBER), rows, MOVED), "join-members")

    many = members.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    texts = slim.join(F.broadcast(members) if many[0] <= BROADCAST_ROWS else members.hint("merge"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th")))
    exact = texts.select(*MEMBER, "text").mapInArrow(_exact_sets(k), f"comp long, rid long, copies long, blocks int, c1 long, c2 long, rep {kind.simpleString()}, rep_th long, shingles binary")
    exact = exact.withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j"))))
    cells = exact.withColumn("cell", cell).select("comp", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), *MEMBER[1:], "block", "shingles")
    cells = packed(cells.repartition("comp", "i", "j"), many[1], VERIFIED).sortWithinPartitions("comp", "i", "j")
    found = save(cells.mapInArrow(_verify(similarity, to_arrow_type(kind)), f"rid long, label long, links long, name {kind.simpleString()}, best boolean, one boolean, c1 long, c2 long, rep {kind.simpleString()}, rep_th long, copies long"), "join-links")

    columns = ["c1", "c2", F.col("name").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "best", "rep", "rep_th", F.lit(1).alias("rank")]
    of_set = found.where("one").select(*columns)
    if not sizes.isEmpty():
        of_set = of_set.union(_named(found.where("not one")).select(*columns))
    # sets that no other resembles, but that have copies
    of_set = of_set.union(sets.where("copies > 1").select("c1", "c2", "rep", F.col("copies") - 1, F.lit(True), "rep", "rep_th", F.lit(0)))
    of_set = of_set.groupBy(F.col("c1").alias("m1"), F.col("c2").alias("m2")).agg(F.max_by(F.struct("class_id", "n_links", "best", "rep", "rep_th"), "rank").alias("x"))
    of_set = save(packed(of_set.select("m1", "m2", "x.*"), sets.where("copies > 1").count() + rows, MOVED), "join-of-set")
    out = marks.select("id", "th", F.when(F.col("n") > 0, F.col("c1")).alias("c1"), "c2").join(of_set.hint("merge"), (F.col("m1") == F.col("c1")) & (F.col("c2") == F.col("m2")), "left")
    first = F.col("m1").isNull() | (F.col("best") & F.col("id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th")))
    return out.select("id", "th", F.when(F.col("m1").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("first"))


def similar_classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class) and
    n_links, the number of other documents of at least that similarity."""
    return _classes(docs, k, similarity, recall, id_col, text).select(F.col("id").alias(id_col), "class_id", "n_links")


def one_per_class(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id (of
    rows of one id, that of the smallest text hash); the columns stay."""
    classes = save(_classes(docs, k, similarity, recall, id_col, text), "join-classes")
    # ids that repeat with equal texts are copies of one row, of which one stays
    again = classes.where("first and n_links > 0").groupBy("id", "th").agg(F.count("*").alias("rows")).where("rows > 1").select("id", "th", F.lit(True).alias("again"))
    gone = save(classes.where("not first").select("id", "th").distinct().withColumn("again", F.lit(False)).union(again), "join-gone")
    few = gone.count() <= BROADCAST_ROWS
    # the rows are held in one struct, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own"), F.xxhash64(text).alias("hash"))
    marked = rows.join(F.broadcast(gone) if few else gone.hint("merge"), F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")), "left")
    out = marked.where("again is null")
    if not gone.where("again").isEmpty():
        out = out.unionByName(marked.where("again").dropDuplicates(["own", "hash"]))
    return out.select("doc.*")
