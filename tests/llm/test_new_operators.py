"""Ranked search, Merkle manifest and vector dedup against brute force, with
the edge cases that their docstrings define."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from driftline.llm import lexical as LX
from driftline.llm import merkle as MK
from driftline.llm import vector_dedup as VD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            n = sum(b.values())
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * (10 + 90 * n * n_docs // all_terms))) for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i, s))
        out += [(item, r + 1, x[3], x[4]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def random_docs(seed, n):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "日本", "X9"]
    docs = [(int(i), " ".join(words[j] for j in r.integers(0, len(words), r.integers(1, 25)))) for i in r.permutation(n)]
    docs += [(1000 + i, docs[0][1]) for i in range(30)] + [(docs[3][0], docs[3][1]), (None, docs[0][1]), (None, "w1 w2"), (7000, None), (7001, ""), (7002, "-- \n"), (7003, "w5," * 4000)]
    return docs


@pytest.mark.parametrize("per_set", [200_000, 5])
def test_search_equals_brute_force(spark, per_set, monkeypatch):
    monkeypatch.setattr(LX, "CELLS", 64)
    docs = random_docs(5, 120)
    items = [("a", "w1 W2 w3 w1"), ("a", "w1 W2 w3 w1"), ("b", "nothing here"), (None, "été x9 w7 w8 w9"), ("c", None), ("d", "..."), ("e", "日本 w5 " + " ".join(f"w{i}" for i in range(12)))]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, item long").repartition(5)
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id string, text string, doc_id int")
    got = LX.search(d, b, 10, per_set=per_set)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, 10)


def test_search_of_nothing(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert LX.search(d, b).count() == 0 and LX.search(spark.createDataFrame([(1, "w1")], d.schema), b.limit(0)).count() == 0
    assert LX.search(spark.createDataFrame([(1, None), (2, "??")], d.schema), b).count() == 0


def test_long_texts_are_cut_between_words():
    text = ("é" * 700 + " b " * 50 + "c" * 900 + ",d").encode()
    for most in (7, 64, 1000, 1 << 20):
        got = [w for p in LX.pieces(np.frombuffer(text, np.uint8), most) for w in p.split()]
        assert got == [w.encode() for w in terms(text.decode())]


def test_scores_of_any_size_are_exact():
    bag = np.array([(0, 10**7), (1, 3)], LX.ENTRY).tobytes()
    got = LX.class_scores([bag, b"", bag], np.array([11, 12, 10**9]), np.array([20_000, 7]), np.array([0, 2, 3]), np.array([0, 1, 1]), 2)
    one = lambda m: [20_000 * (10**16 // (10**10 + 8 * m)), 20_000 * (10**16 // (10**10 + 8 * m)) + 7 * (3 * 10**9 // (3000 + 8 * m))]
    assert got.tolist() == [one(11), [0, 0], one(10**9)]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_audit(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(f, r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(lv, i):
        out = []
        for level in lv[:-1]:
            a = i - i % 3
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
            i //= 3
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    own = {s: levels([leaf(r) for r in trees[s]]) for s in names}
    top = levels([own[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            way = path(own[s], i) + path(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            cur = leaf((*r[:4], r[4].replace("\n", "") if r[4] is not None and even else r[4]))
            for left, right in way:
                cur = H(left, cur, right)
            out.append((r[0], leaf(r), own[s][-1][0], top[-1][0], H(*[x for p in way for x in p]), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("band", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, band, monkeypatch):
    monkeypatch.setattr(MK, "BAND", band)
    monkeypatch.setattr(MK, "ROWS", 30)
    rows = [(i, "abcdé"[i % 4 if i % 3 else 4], "en" if i % 5 else None, i, f"t{i}" + "\n" * (i % 2)) for i in range(130)]
    rows += [(200, None, None, None, None), (201, "one", "fr", 1, ""), (202, "one\n", "fr", 1, "a\nb"), (None, "a", "fr", 1, "x\ny"), (7, "a", "en", 1, "other"), (7, "a", "en", 1, "other")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, lo long").repartition(4)
    got = MK.audit(df, ["doc_id", "source", "lang", "n_chars", "text"])
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_audit(rows)


def test_manifest_of_few_and_none(spark):
    schema, columns = "doc_id long, source string, lang string, n_chars long, text string", ["doc_id", "source", "lang", "n_chars", "text"]
    assert MK.audit(spark.createDataFrame([], schema), columns).count() == 0
    one = MK.audit(spark.createDataFrame([(1, "s", None, 3, "abc")], schema), columns).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == H() and one["verified"]


def plain_links(rows, cosine):
    unit = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            m = max(map(abs, v))
            n = math.sqrt(math.fsum((x / m) ** 2 for x in v))
            unit[i] = [x / m / n for x in v]
    near = {i: {j for j in unit if j != i and math.fsum(a * b for a, b in zip(unit[i], unit[j])) >= cosine} if i in unit else set() for i in range(len(rows))}
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        name = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((own, len(near[i]), name, own == name))
    return sorted(out, key=repr)


def vectors_with_groups(seed, dims):
    r = np.random.default_rng(seed)
    base = r.normal(size=(60, dims))
    rows = [(int(i), (base[i % 60] + r.normal(size=dims) * 0.02 * (i // 60)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[i][1]) for i in range(40)] + [(3000, [x * 3.5e150 for x in rows[5][1]]), (3001, [x * 1e-200 for x in rows[5][1]])]
    rows += [(None, rows[7][1]), (7, rows[7][1]), (4000, None), (4001, []), (4002, [0.0] * dims), (4003, [float("nan")] + [1.0] * (dims - 1)), (4004, [float("inf")] + [1.0] * (dims - 1)), (4005, [None] + [1.0] * (dims - 1)), (None, None)]
    rows += [(4006, [1.0, 2.0]), (4007, [1.0, 2.0] + [0.0] * (dims - 2)), (4008, [1.0, 2.0, -0.0])]
    return rows


@pytest.mark.parametrize("per_cell, block", [(4096, 1 << 20), (20, 1 << 20), (40, 8 * 70)])
def test_links_equal_brute_force(spark, per_cell, block, monkeypatch):
    monkeypatch.setattr(VD, "BLOCK", block)
    monkeypatch.setattr(VD, "STRIP", 1000)
    rows = vectors_with_groups(3, 8)
    df = spark.createDataFrame([(i, v, 5, 6, "x") for i, v in rows], "vec_id long, embedding array<double>, links int, rid long, cell string").repartition(5)
    got = VD.linked(df, 0.9, per_cell=per_cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_links(rows, 0.9)
    kept = VD.representatives(df, 0.9, per_cell=per_cell)
    assert kept.columns == df.columns
    assert {r["vec_id"] for r in kept.collect()} == {r[0] for r in plain_links(rows, 0.9) if r[3]} | {None}


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert VD.linked(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0])], none.schema)
    assert sorted(map(tuple, VD.linked(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_join_runs_outside_the_repository(tmp_path):
    """Workers find the package though neither PYTHONPATH nor the working
    folder leads to it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from driftline.llm.ngram_join import similar_classes
text = " ".join(f"word{{i}}" for i in range(60))
print("rows", sorted(tuple(r) for r in similar_classes(s.createDataFrame([(1, text), (2, text + " more"), (3, "other")], "doc_id long, text string")).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows [(1, 1, 1), (2, 1, 1), (3, 3, 0)]" in out.stdout, out.stderr[-2000:]


def test_lookup_of_lines_is_not_quadratic(spark):
    """Documents of many shared lines cost about as much a line as others."""
    import time

    from driftline.llm import line_dedup as LD

    def took(lines):
        text = "\n".join(f"shared line {i}" for i in range(lines))
        df = spark.createDataFrame([(i, text + f"\nown {i}") for i in range(12)], "doc_id long, text string")
        began = time.time()
        rows = LD.dedup_lines(df, 10).select("doc_id", "n_lines", "n_dropped", "kept").collect()
        assert {(r["n_lines"], r["n_dropped"], r["kept"]) for r in rows} == {(lines + 1, lines, f"own {r['doc_id']}") for r in rows}
        return time.time() - began

    took(100)
    assert took(32_000) < 4 * took(2_000) + 20
