"""Benchmark decontamination with a broadcast hash set of test n-grams.

DataFrame and SQL functions only.  The benchmark's windows (``n`` consecutive
normalised words; a shorter item is one window) are hashed.  A set of at most
about ``per_set`` windows is broadcast; every position of every document is
looked up in it by the hash of its first words, what remains by the hash of the
whole window, and hits are verified on their words.  No document is shuffled
for that, and only hits become rows.  A benchmark of more windows is dealt to
several sets, for each of which the documents are scanned.

Defined results: a null or wordless text has no words and no hits; a null,
empty or wordless item has no windows; repeated rows are judged one by one;
items with equal ids count once; items without an id hit but are not counted;
an empty table, or an empty benchmark, hits nothing; other columns may have any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_PATTERN, WORD_PATTERN, ascii_lower, save

#: Words that open a window; windows of one broadcast set, and their bytes.
HEAD, PER_SET, SET_BYTES = 3, 250_000, 32 << 20


def words_of(text: Column) -> Column:
    """The normalised words of a text; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP_PATTERN), "")


def benchmark_windows(bench: DataFrame, n: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """(window, k, items): each distinct window, its length, and its items."""
    words = bench.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where("size(words) > 0")
    k = F.least(F.size("words"), F.lit(n))
    each = words.select("item", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.array_join(F.slice("words", i + 1, k), " "))).alias("window"))
    return each.groupBy("window", "k").agg(F.collect_set("item").alias("items"))


def _head(words: Column, i: Column, k: int) -> Column:
    """Hash of the first words of the window of ``k`` words at ``i``."""
    return F.xxhash64(*[F.get(words, i + j) for j in range(min(k, HEAD))])


def hash_sets(windows: DataFrame, per_set: int) -> list[DataFrame]:
    """The windows in sets of about ``per_set`` and ``SET_BYTES``, each small enough to broadcast:
    group, k, head (hash of the first words), h (of all words), window."""
    w = F.split("window", " ")
    head = F.when(F.col("k") >= 3, _head(w, F.lit(0), 3)).when(F.col("k") == 2, _head(w, F.lit(0), 2)).otherwise(_head(w, F.lit(0), 1))
    many = windows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-many["rows"] // per_set), -(-many["bytes"] // SET_BYTES))
    dealt = save(windows.select("k", head.alias("head"), F.xxhash64(w).alias("h"), "window", F.pmod(F.xxhash64("window"), F.lit(n)).alias("set")), "windows-dealt")
    return [dealt.where(F.col("set") == i).drop("set") for i in range(n)]


def hits(rows: DataFrame, windows: DataFrame, per_set: int = PER_SET) -> DataFrame:
    """(uid, pos, k, window) of every window that occurs in ``rows`` (uid,
    words).  Each set of windows is broadcast and all rows are scanned for it:
    positions whose first words open a window of the set are found by one hash,
    those that hold a whole window by another, and these are verified."""
    out = None
    sizes = [r["k"] for r in windows.select("k").distinct().collect()]  # at most n values
    for found in hash_sets(windows, per_set):
        heads = found.select("head", "k").distinct()
        for first in sorted({min(k, HEAD) for k in sizes}):
            own = heads.where(F.least(F.col("k"), F.lit(HEAD)) == first)
            each = rows.select("uid", "words", F.posexplode("words").alias("pos", "word")).where(F.col("pos") <= F.size("words") - first)
            # a set holds at most about per_set windows of n words
            opened = each.join(F.broadcast(own), _head(F.col("words"), F.col("pos"), first) == F.col("head"))
            whole = F.slice("words", F.col("pos") + 1, F.col("k"))
            opened = opened.where(F.col("pos") + F.col("k") <= F.size("words")).select("uid", "words", "pos", "k", F.xxhash64(whole).alias("whole"))
            same = (F.col("whole") == F.col("h")) & (F.col("k") == F.col("wk")) & (F.array_join(whole, " ") == F.col("window"))
            each = opened.join(F.broadcast(found.select("h", F.col("k").alias("wk"), "window")), same).select("uid", "pos", "k", "window")
            out = each if out is None else out.union(each)
    return out


def scan(docs: DataFrame, bench: DataFrame, n: int = 10, text: str = "text", bench_text: str = "text", item: str = "item_id", per_set: int = PER_SET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, found, windows): ``docs`` as struct ``doc`` with a number
    ``uid``; the verified hits of each row that has any, as ``uid`` and
    ``hits``; and the benchmark's windows."""
    windows = save(benchmark_windows(bench, n, bench_text, item), "windows")
    # written with their numbers, so that these name the same rows again
    rows = save(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("uid")), "rows")
    each = hits(rows.select("uid", words_of(F.col(f"doc.{text}")).alias("words")), windows, per_set)
    if each is None:
        each = rows.sparkSession.createDataFrame([], "uid long, pos int, k int, window string")
    found = each.groupBy("uid").agg(F.collect_list(F.struct("pos", "k", "window")).alias("hits"))
    return rows, save(found, "hits"), windows


def hit_positions(hits: Column) -> Column:
    """Positions of all words inside any hit window, each once."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["k"] - 1))))


def annotate(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256,
    contaminated.  Only ids, counts and hit windows are shuffled."""
    rows, found, windows = scan(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), bench, n, **kw)
    each = found.select("uid", F.explode(F.array_distinct(F.col("hits.window"))).alias("window")).join(windows.select("window", "items"), "window")
    items = each.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    marks = found.select("uid", F.size(hit_positions(F.col("hits"))).alias("n_hit")).join(items, "uid").withColumnRenamed("uid", "hit")
    slim = rows.select("uid", F.col("doc.id").alias("id"), F.size(words_of(F.col("doc.text"))).alias("n_words"))
    none = F.array().cast("array<string>")
    return slim.join(marks, F.col("uid") == F.col("hit"), "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, mode: str = "documents", text: str = "text", **kw) -> DataFrame:
    """``docs`` without contaminated documents (mode ``documents``), or with
    each hit word and the separators after it cut out (mode ``spans``)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    rows, found, _ = scan(docs, bench, n, text=text, **kw)
    if mode == "documents":
        return rows.join(found.select("uid"), "uid", "left_anti").select("doc.*")
    # pieces: what stands before the first word, then each word with what follows it
    upper = WORD_PATTERN.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(F.col("doc")[text], F.lit(f"{upper}[^0-9A-Za-z\\x80-\\x{{10FFFF}}]*"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.array_contains(F.col("gone"), i))
    head = F.regexp_extract(F.col("doc")[text], r"^[^0-9A-Za-z\x80-\x{10FFFF}]*", 0)
    both = rows.join(found.select("uid", hit_positions(F.col("hits")).alias("gone")), "uid", "left")
    cut = both.withColumn("cut", F.when(F.col("gone").isNull(), F.col("doc")[text]).otherwise(F.concat(head, F.array_join(kept, ""))))
    return cut.select(*[F.col("cut").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
