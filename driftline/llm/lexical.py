"""Ranked lexical search for a set of items by bag deduplication.

Every document is restricted to the words that the items use.  Documents that
are left with the same term frequencies and the same length figure ``m`` form a
class: they are brought together by a hash and verified on the frequencies
themselves.  Each class is scored once against all items.  An item's k best
documents lie in its k best classes (by score, then by their smallest id), so
only these classes are expanded to their members, in ascending order of id.

Scale: texts are read once per set of items and never shuffled; a row of
(term, count) pairs per document is written.  Items are dealt to sets of at
most about ``PER_SET`` postings, so the vocabulary that is broadcast is bounded
(one item alone may pass that).  Classes are counted by a combined aggregate:
copies cost a row per task.  A task keeps k classes per item of its set, and
windows over members and results keep k rows per task before they shuffle.

Defined results: null and wordless texts are in no count and no result; a null
or wordless item has no rows; each row of the items is an item of its own, also
if ids repeat or are null; a term counts once in an item; equal scores are in
ascending order of id, null ids last; repeated documents are ranked one by one;
ids of documents are integers; other columns are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, save, ship
from .decontaminate import words_of
from .language_id import text_buffer

#: Postings of one set of items; bytes of a text that are split at once; cells
#: of a score matrix; bytes of chosen classes that may be broadcast.
PER_SET, PIECE, CELLS, BROADCAST_BYTES = 200_000, 1 << 20, 1 << 22, 16 << 20
#: Word bytes with A-Z lower-cased; all others become spaces.
TERM_BYTES = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b).isdigit() and b < 128 or chr(b) in LOWER or b >= 128 else 32 for b in range(256))
ENTRY = np.dtype([("term", "<u4"), ("tf", "<u4")])


def pieces(data: np.ndarray, most: int = PIECE) -> Iterator[bytes]:
    """A text's words, separated by spaces, in pieces that cut no word."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        piece = data[at:end].tobytes().translate(TERM_BYTES)
        if end < len(data):
            cut = piece.rfind(b" ") + 1
            while not cut and end < len(data):  # one word fills the piece
                end = min(end + most, len(data))
                piece = data[at:end].tobytes().translate(TERM_BYTES)
                cut = piece.rfind(b" ") + 1 if end < len(data) else len(piece)
            piece = piece[:cut] if end < len(data) else piece
        at += len(piece)
        yield piece


def _entries(counts: dict) -> bytes:
    out = np.array(sorted(counts.items()), np.uint32).reshape(-1, 2)
    return np.ascontiguousarray(out).view(ENTRY).tobytes()


def _restrict(vocabulary):
    """Rows (id, text): id, n (all terms) and bag (entries of the vocabulary's
    terms); last, the task's document frequencies as one row without n."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, df = vocabulary.value, Counter()
        names = ["id", "n", "bag"]
        for batch in batches:
            data, offsets = text_buffer(batch, "text")
            n, bags = np.zeros(len(batch), np.int64), []
            for i in range(len(batch)):
                counts = Counter()
                for piece in pieces(data[offsets[i] : offsets[i + 1]]):
                    words = piece.split()
                    n[i] += len(words)
                    counts.update(map(index.get, words))
                counts.pop(None, None)
                df.update(counts.keys())
                bags.append(_entries(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(bags, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([_entries(df)], pa.binary())], names=names)

    return run


def _frequencies(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        got = np.frombuffer(b"".join(batch.column(0).to_pylist()), ENTRY)
        yield pa.RecordBatch.from_arrays([pa.array(got["term"].astype(np.int64)), pa.array(got["tf"].astype(np.int64))], names=["term", "df"])


def class_scores(bags: list[bytes], m: np.ndarray, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int) -> np.ndarray:
    """(classes, items): whole-number scores.  ``first`` has each term's first
    posting in ``items``, and one more."""
    entries = np.frombuffer(b"".join(bags), ENTRY)
    row = np.repeat(np.arange(len(bags)), [len(b) // ENTRY.itemsize for b in bags])
    term, tf = entries["term"].astype(np.int64), entries["tf"].astype(np.int64)
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    many = first[term + 1] - first[term]
    start = np.cumsum(many) - many
    posting = np.arange(int(many.sum())) - np.repeat(start, many) + np.repeat(first[term], many)
    key, part = np.repeat(row * n_items, many) + items[posting], np.repeat(part, many)
    size = len(bags) * n_items
    # two sums of halves, each exact in doubles
    low, high = np.bincount(key, part & 0x3FFFFFF, size), np.bincount(key, part >> 26, size)
    return (low.astype(np.int64) + (high.astype(np.int64) << 26)).reshape(len(bags), n_items)


def _first_k(item, score, none, least, k: int) -> np.ndarray:
    """Places of each item's first k rows by score, then id, null ids last."""
    order = np.lexsort((least, none, -score, item))
    at = item[order]
    new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else np.zeros(0, int)
    return order[nth < k]


def _best_classes(shared, k: int):
    """Rows (m, bag, least): a task's k best classes for each item."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, first, items, n_items = shared.value
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
        bound = np.ones(n_items, np.int64)
        step = max(1, CELLS // max(1, n_items))
        for batch in batches:
            m_all, bags_all, least_all = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2)
            none_all = least_all.is_null().to_numpy(zero_copy_only=False)
            least_all = least_all.fill_null(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(m_all), step):
                m, bags, none, least = m_all[a : a + step], bags_all[a : a + step], none_all[a : a + step], least_all[a : a + step]
                scores = class_scores(bags, m, weights, first, items, n_items)
                low = np.maximum(bound, np.partition(scores, -k, axis=0)[-k]) if len(bags) > k else bound
                row, item = np.nonzero(scores >= low)
                new = [item, scores[row, item], none[row], least[row], m[row], np.array([bags[r] for r in row] + [None], object)[:-1]]
                held = [np.concatenate(x) for x in zip(held, new)]
                keep = _first_k(*held[:4], k)
                held = [x[keep] for x in held]
                many = np.bincount(held[0], minlength=n_items)
                last = np.zeros(n_items, np.int64)
                last[held[0][::1]] = held[1]  # rows of an item are in order: the last one stays
                bound = np.where(many >= k, last, 1)
        item, score, none, least, m, bags = held
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(least, pa.int64(), mask=none), pa.array(m), pa.array(list(bags), pa.binary())], names=["item", "score", "least", "m", "bag"])

    return run


def item_sets(items: DataFrame, per_set: int) -> int:
    """Sets that the items (no, terms) are dealt to by their number, so that no
    set passes ``per_set`` postings unless one item does so alone."""
    facts = items.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    sets = max(1, -(-facts["postings"] // per_set))
    while sets > 1 and sets < facts["rows"]:
        largest = items.groupBy(F.pmod(F.xxhash64("no"), F.lit(sets))).agg(F.sum(F.size("terms")).alias("p")).agg(F.max("p")).first()[0]
        if largest <= per_set:
            break
        sets *= 2
    return sets


def _search_set(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """(no, rank, id, score) for one set of items, given as (no, terms)."""
    spark = docs.sparkSession
    terms = sorted({t for r in rows for t in r["terms"]})
    index = {t.encode(): i for i, t in enumerate(terms)}
    bags = save(docs.mapInArrow(_restrict(spark.sparkContext.broadcast(index)), "id long, n long, bag binary"), "lexical-bags")
    totals = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    found = bags.where("n is null").select("bag").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most a row per term of the set
    if not found:
        return None
    n_docs, weights = totals["docs"], np.zeros(len(terms), np.int64)
    for r in found:
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    of_term = [[] for _ in terms]
    for i, r in enumerate(rows):
        for t in r["terms"]:
            of_term[index[t.encode()]].append(i)
    first = np.concatenate([[0], np.cumsum([len(x) for x in of_term])]).astype(np.int64)
    postings = np.array([i for x in of_term for i in x], np.int64)
    shared = spark.sparkContext.broadcast((weights, first, postings, len(rows)))

    m = F.lit(100 - 90) + F.expr(f"(90L * n * {n_docs}L) div {totals['terms']}L")
    members = bags.where("n is not null and octet_length(bag) > 0").select("id", "bag", m.alias("m")).withColumn("h", F.xxhash64("m", "bag"))
    # brought together by h, verified by m and bag
    classes = members.groupBy("h", "m", "bag").agg(F.min("id").alias("least"))
    best = classes.select("m", "bag", "least").mapInArrow(_best_classes(shared, k), "item long, score long, least long, m long, bag binary")
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("least").asc_nulls_last(), "m", "bag")
    best = save(best.withColumn("nth", F.row_number().over(by_item)).where(F.col("nth") <= k), "lexical-best")
    chosen = save(best.select("m", "bag").distinct().withColumn("class", F.monotonically_increasing_id()), "lexical-classes")
    small = (chosen.agg(F.sum(F.octet_length("bag") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    near = lambda df: F.broadcast(df) if small else df.hint("merge")
    keyed = chosen.select(F.xxhash64("m", "bag").alias("h"), F.col("m").alias("cm"), F.col("bag").alias("cbag"), "class")
    own = members.join(near(keyed), "h").where("m = cm and bag = cbag").select("class", "id")
    by_class = Window.partitionBy("class").orderBy(F.col("id").asc_nulls_last())
    own = save(own.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k).drop("nth"), "lexical-members")
    scored = best.join(near(chosen), ["m", "bag"]).select("item", "score", "class").join(own, "class")
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)
    numbers = spark.createDataFrame([(i, r["no"]) for i, r in enumerate(rows)], "item long, no long")
    return ranked.join(numbers, "item").select("no", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", per_set: int = PER_SET) -> DataFrame:
    """item, rank, id, score: each item's ``k`` documents of the highest scores
    above 0."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item).alias("item"), F.array_distinct(words_of(F.col(item_text))).alias("terms")).where("size(terms) > 0")
    asked = save(asked.withColumn("no", F.monotonically_increasing_id()), "lexical-items")
    sets, out = item_sets(asked, per_set), None
    for s in range(sets):
        rows = asked.where(F.pmod(F.xxhash64("no"), F.lit(sets)) == s).select("no", "terms").collect()  # at most per_set postings
        got = _search_set(slim, rows, k) if rows else None
        out = got if out is None else out if got is None else out.union(got)
    if out is None:
        out = spark.createDataFrame([], "no long, rank int, id long, score long")
    return out.join(asked.select("no", "item"), "no").select(F.col("item").alias(item), "rank", F.col("id").alias(id_col), "score")
