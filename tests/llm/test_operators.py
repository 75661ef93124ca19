"""The operators on small tables: brute force, and the cases that each
docstring defines (nulls, empty texts, ties, repeated rows, empty tables,
columns with clashing names)."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import decontaminate as DC
from driftline.llm import language_id as LI
from driftline.llm import line_dedup as LD
from driftline.llm import mixing as MX
from driftline.llm import ngram_join as NJ
from driftline.llm import quality as QU
from driftline.llm import sharding as SH
from driftline.llm import token_output as TO
from driftline.llm import topk as TK
from driftline.llm import url_filter as UF
from driftline.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, uid long, `key` string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, 20, n), r.integers(0, 50, n)))


ODD = [
    (1, None, "en", "b", 1, "x"),
    (2, "", "en", None, 1, "x"),
    (3, prose(1, 40), None, "a", 2, None),
    (3, prose(1, 40), None, "a", 2, None),
    (4, prose(1, 40) + " new", "en", "a", 3, "y"),
    (None, prose(2, 30), "fr", "c", 4, "y"),
    (5, "a\nB \n\n b\nc", "en", "b", 5, "z"),
    (6, prose(3, 3000), "en", "a", 6, "z"),
    (7, "été 日本語 123 !!!", "fr", "b", 7, ""),
    (8, " \t\n ", "fr", "b", 8, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1. mixing
def test_mix_takes_near_targets(spark):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(n)), None, f"s{i % 7}", 0, "") for i, n in enumerate(r.pareto(1.5, 700) * 30 + 1)]
    got = MX.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    again = MX.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert {g["doc_id"]: g["copies"] for g in got} == {g["doc_id"]: g["copies"] for g in again}
    taken, target, size = Counter(), {}, {}
    for g in got:
        taken[g["source"]] += g["size"] * g["copies"]
        target[g["source"]], size[g["source"]] = g["target"], g["source_size"]
        assert 0 <= g["copies"] <= 2
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s in target:
        assert target[s] <= 2 * size[s] and abs(taken[s] - target[s]) <= 0.02 * target[s]


def test_mix_targets_by_resharing(spark):
    """The closed form equals cutting and resharing round by round."""
    sizes = {"a": 10, "b": 500, "c": 90, None: 33, "d": 0}
    rows = [(i, " ".join(["w"] * n), None, s, 0, "") for i, (s, n) in enumerate(sizes.items())]
    got = {g["source"]: g["target"] for g in MX.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-12}
        if not over:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


def test_mix_edges(odd, none):
    assert MX.mix(odd).count() == len(ODD) and MX.mix(none).count() == 0
    out = MX.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in MX.mix(odd).collect())


# 2. sharding
def test_differencing_balances():
    r = np.random.default_rng(1)
    sums = [(int(x),) + (0,) * 7 for x in r.integers(1, 10_000, 400)]
    load = [0] * 8
    for s, placed in zip(sums, SH.difference(sums)):
        load[placed[0]] += s[0]
        assert sorted(placed) == list(range(8))
    assert max(load) - min(load) <= 3


def plain_differencing(sums):
    """As ``difference``, with every step written out and nothing dropped."""
    parts = []
    for k, s in enumerate(sums):
        piles = sorted(((x, j) for j, x in enumerate(s)), key=lambda p: (-p[0], p[1]))
        parts.append((k, [(x, [(k, j)]) for x, j in piles]))
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][-1][0] - p[1][0][0], p[0]))  # largest spread first
        (_, a), (_, b) = parts[:2]
        both = [(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))]
        parts = [*parts[2:], (made, sorted(both, key=lambda p: -p[0]))]
        made += 1
    return {member: shard for shard, (_, members) in enumerate(parts[0][1]) for member in members}


def test_differencing_equals_plain_steps():
    r = np.random.default_rng(7)
    single = [(int(x),) + (0,) * 7 for x in [*r.integers(1, 50, 60), 9_000]]  # with ties and one giant
    several = [tuple(map(int, r.integers(0, 500, 5))) for _ in range(40)]
    for sums in (single, several, single[:1]):
        want = plain_differencing(sums)
        assert {(k, j): shard for k, row in enumerate(SH.difference(sums)) for j, shard in enumerate(row)} == want


def test_shards(spark, odd, none):
    rows = [(i, prose(i % 90, 5 + i % 60), None, None, 0, "") for i in range(300)]
    for df, n in ((spark.createDataFrame(rows, SCHEMA), 300), (odd, len(ODD))):
        got = SH.shard(df).collect()
        assert len(got) == n and {g["law"] for g in got} == {"bytes"}
        for s in range(8):
            slots = sorted(g["slot"] for g in got if g["shard"] == s)
            assert slots == list(range(len(slots)))
    load = Counter()
    text = {r[0]: r[1] for r in rows}
    where = {}
    for g in SH.shard(spark.createDataFrame(rows, SCHEMA)).collect():
        load[g["shard"]] += g["size"]
        assert g["text_crc32"] == zlib.crc32(text[g["doc_id"]].encode()) and g["size"] == len(text[g["doc_id"]].encode()) + 1
        assert where.setdefault(text[g["doc_id"]], g["shard"]) == g["shard"]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())
    assert SH.shard(none).count() == 0


# 3. line dedup
def test_perfect_hash_is_exact():
    r = np.random.default_rng(2)
    h = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    n = r.integers(1, 400, len(h))
    probe = LD.Probe(LD.build(h, n, 300), 300)
    assert sorted(probe.index(h)) == list(range(len(h)))
    assert (probe.count(h) == np.minimum(n, 300)).all()
    foreign = np.setdiff1d(r.integers(0, 2**63, 5000).astype(np.uint64), h)
    assert (probe.count(foreign) > 0).mean() < 0.002


def test_bloom_filter_holds_all_and_little_else(spark):
    tids = spark.range(20_000).selectExpr("xxhash64(id) as tid")
    values = np.array([r[0] for r in tids.collect()])
    words = LD.bloom(tids.where("pmod(tid, 2) = 0"), least=64)
    got, own = LD.in_bloom(words, values), values % 2 == 0
    assert got[own].all() and got[~own].mean() < 0.02
    assert LD.in_bloom(LD.bloom(tids, most=64, least=64), values).all()  # full, so all may be in it
    assert not LD.in_bloom(LD.bloom(tids.where("false")), values).any()


def test_line_dedup(spark, odd, none):
    rows = [(i, "\n".join(["Shared  ", f"own {i}", "", f"half {i % 2}" if i < 18 else "x", " \tsHARED"]), None, None, 0, "") for i in range(30)] + ODD
    want = {}
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    count = Counter(k for r in rows for k in set(keys(r[1])))
    for r in rows:
        kept = [x for x, k in zip((r[1] or "").split("\n"), keys(r[1])) if not (k and count[k] >= 10)]
        want.setdefault(r[0], set()).add((len(keys(r[1])), len(keys(r[1])) - len(kept), "\n".join(kept)))
    got = LD.dedup_lines(spark.createDataFrame(rows, SCHEMA), 10, per_shard=20, per_probe=15).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g["n_lines"], g["n_dropped"], g["kept"]) in want[g["doc_id"]]
    assert LD.dedup_lines(none).count() == 0 and LD.dedup_lines(odd).columns[: len(odd.columns)] == odd.columns


# 4. url filters
def test_url_aliases(spark):
    pages = [
        (1, "https://www.Example.com/en/12?x#y", None),
        (2, "http://free.test/a", '<html><link rel="canonical" href="https://www.example.com/en/12?x"></html>'),
        (3, "http://other.test/b#top", '<meta http-equiv="refresh" content="0; url=http://free.test/a">'),
        (4, "http://lone.test/", "<p>canonical</p>"),
        (5, None, None),
        (6, "no scheme", "x"),
        (7, "https://example.com/en/77", '<link href="//www.example.com/en/12?x" rel=canonical>'),
        (8, "http://mix.test/q", '<link rel="canonical" href="https://a.net/de/1"> <meta http-equiv=refresh content="1;url=http://b.org/es/2">'),
        (9, "https://a.net/de/1", ""),
        (10, "http://b.org/es/2", ""),
        (10, "http://b.org/es/2", ""),
    ]
    rules = spark.createDataFrame([("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "org", "/es/")], "action string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in UF.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[1] == ("www.example.com", "/en/12", "com/en/", "block")
    # 7 is explicitly allowed and in the same class as 1, 2 and 3: allow has precedence for those without a rule
    assert got[7][3] == "allow" and got[2][2:] == (None, "allow") and got[3][2:] == (None, "allow")
    assert got[4][3] == "allow" and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[8][2:] == (None, "allow") and got[9][3] == "allow" and got[10][3] == "block"
    blocked = UF.judge(spark.createDataFrame(pages[:4], "page_id long, url string, html string"), rules)
    assert {r["page_id"]: r["verdict"] for r in blocked.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}
    assert UF.judge(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for n in parent}


# 5. language
def brute_phrases(sample: bytes, text: bytes) -> int:
    code = lambda t: LI.normalise(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()
    s, t, i, total = code(sample), code(text), 0, 0
    while i < len(t):
        n = 1
        while i + n < len(t) and t[i : i + n + 1] in s:
            n += 1
        total, i = total + 1, i + n
    return total


def test_cross_parsing_equals_longest_matches():
    samples = {"x": (prose(5, 200).encode(), 0.0), "y": ("été l'âme ".encode() * 20, 1.0)}
    # also texts of many blocks, with matches longer than a block
    texts = [prose(6, 150), "a", "", "!!! ???", "été été", prose(5, 60), prose(6, 900) + " été " * 300, prose(5, 200) * 3, "x" * 5000, "été l'âme " * 500]
    raw = [t.encode() for t in texts]
    codes, at = LI.normalise(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = LI.Model(samples).phrases(codes, at)
    for i, t in enumerate(raw):
        assert list(got[i]) == [brute_phrases(samples[k][0], t) for k in ("x", "y")]


@pytest.mark.parametrize("seed", range(3))
def test_language_rows_do_not_overlap(seed):
    r = np.random.default_rng(seed)
    rows = [{int(c): int(r.integers(0, 400)) for c in r.choice(LI.WIDTH, k, replace=False)} for k in [0, 0, 1, LI.WIDTH, *r.integers(0, 5, 300), *r.integers(0, 60, 40)]]
    at, size = LI.displaced(rows)
    slots = [begin + c for begin, row in zip(at, rows) for c in row]
    assert len(set(slots)) == len(slots) and len(set(at)) == len(rows) and max(slots) < size
    assert LI.displaced([])[0] == [] and LI.displaced([{}, {}])[0] in ([0, 1], [1, 0])


def test_language_tables_of_many_scripts_are_small():
    """200 languages of as many scripts as bytes allow stay under 1 GB."""
    r, samples = np.random.default_rng(1), {}
    for i, first in enumerate([0x61, 0x400, 0x900, 0x4E00, 0xAC00, 0x1200]):
        words = ["".join(chr(first + x) for x in r.integers(0, 26 if first == 0x61 else 300, r.integers(2, 9))) for _ in range(2_000)]
        samples[f"l{i}"] = (" ".join(words[j] for j in r.zipf(1.3, 40_000) % 2_000).encode()[:48_000].decode("utf-8", "ignore").encode(), 1.0)
    model = LI.Model(samples)
    held = [sum(x.nbytes for x in table[:3]) for table in model.tables]
    assert model.width > 100 and max(held) * 200 < 1_000_000_000


def test_language_edges(odd, none, spark):
    got = {(r["doc_id"], r["lang_pred"]): r for r in LI.predict_languages(odd).collect()}
    assert (1, "und") in got and (2, "und") in got and (8, "und") in got
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert LI.predict_languages(none).count() == 0
    kept = LI.accepted(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, None, 5, 6, 7}


def test_language_sample_is_whole_rows(spark):
    rows = [(i, "en", prose(i, 40)) for i in range(200)] + [(900 + i, "en", prose(i, 3000)) for i in range(3)] + [(1000, "fr", prose(7, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = LI.learn(docs, sample_rows=30, sample_bytes=4000)
    texts = {lang: {t for _, x, t in rows if x == lang} for lang in ("en", "fr")}
    assert got["fr"][0].decode() in texts["fr"]  # its only row, whole
    parts = got["en"][0].decode().split("\n")
    assert 3 < len(parts) <= 30 and set(parts) <= texts["en"] and sum(map(len, parts)) <= 4000


def test_texts_of_no_language_go(spark):
    r = np.random.default_rng(11)
    docs = [(i, prose(i, 60), "en") for i in range(40)]
    junk = ["".join(chr(97 + c) for c in r.integers(0, 26, 4000)), "чужой язык " * 50]
    docs += [(100 + i, t, None) for i, t in enumerate(junk)] + [(200, "zq", None), (201, prose(300, 2000), None)]
    kept = {r["doc_id"] for r in LI.accepted(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(40)) | {200, 201}


def test_language_held_out(spark):
    from driftline.llm.queries import op5_language_id, table

    d = "/root/testdata/sf0.01"
    both = op5_language_id(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    rows = both.collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


# 6. tokens
def test_blocks_round_trip():
    r = np.random.default_rng(4)
    for ids in (r.integers(0, 50_000, 1024), np.full(7, 9), np.array([2]), np.append(r.integers(100, 120, 500), [2**32 - 1, 0]), np.arange(1024)):
        ids = ids.astype(np.uint32)
        assert (TO.unpack_block(memoryview(TO.pack_block(ids)), 0) == ids).all()
    part, nth, docs, counts, ids = TO.read_segment(TO.write_segment([5, None, 7], np.array([3000, 1, 0]), np.arange(3001).astype(np.uint32), 4, 2))
    assert (part, nth) == (4, 2) and docs == [5, None, 7] and list(counts) == [3000, 1, 0] and (ids == np.arange(3001)).all()


def test_tokens(spark, odd, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    strange = ["a  b", "x <|endoftext|> y", "it's can't've", "  b 　c", "a\n b\t c", "don 't", "U.S. 1st 2  3"]
    rows = ODD + [(100 - i, t, None, None, 0, "") for i, t in enumerate(strange)]
    got = sorted(TO.read_tokens(*TO.write_tokens(spark.createDataFrame(rows, SCHEMA), P.path("byte_bpe_50k.json"), partitions=3)).collect(), key=lambda r: r["start"])
    at, left = 0, Counter((r[0], r[1] or "") for r in rows)
    ids_of = {t: tok.encode(t, add_special_tokens=False).ids + [2] for _, t in left}
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    for r in got:
        assert r["start"] == at
        crcs = {(len(ids_of[t]), zlib.crc32(struct.pack(f"<{len(ids_of[t])}I", *ids_of[t]))) for d, t in left if d == r["doc_id"]}
        assert (r["n_tokens"], r["ids_crc32"]) in crcs
        at += r["n_tokens"]
    assert TO.read_tokens(*TO.write_tokens(none, P.path("byte_bpe_50k.json"))).count() == 0


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def encoded(enc, texts):
    raw = [t.encode() for t in texts]
    ids, upto = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])]


def test_encoder_equals_direct_encoding(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    enc = TO.Encoder(P.path("byte_bpe_50k.json"))
    direct = lambda texts: [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    parts = ["a", "Zed", "don't", "'s", "''re", "12", "3a", "b4", ".", "?!", " ", "  ", "\n", "\n\n", "\t", "\x00", "\u00a0", "\u3000", "é", "日本", "½", "-", "<|endoftext|>", "'", "x'", "9'll"]
    r = np.random.default_rng(8)
    texts = ["".join(parts[i] for i in r.integers(0, len(parts), n)) for n in r.integers(0, 30, 3000)]
    texts += ["a -", " -", " ,\x00", thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), " " + thue_morse(2048, "a", "b"), ""]
    assert encoded(enc, texts) == direct(texts)
    assert encoded(enc, texts[::-1]) == direct(texts[::-1])
    # even if hashes say little, bytes decide
    monkeypatch.setattr(TO, "range_hashes", lambda data, a, b: (b - a).astype(np.uint64) % np.uint64(5))
    assert encoded(enc, texts[:400]) == direct(texts[:400])


def test_other_tokenizers_encode_whole_texts():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    assert TO.cut_by_pattern(P.path("byte_bpe_50k.json")) and not TO.cut_by_pattern(path)
    enc = TO.Encoder(path)
    texts = ["Some words, here", "", "two\nlines", "Some words, here", "a" * 300]
    assert encoded(enc, texts) == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


# 7. top k
def test_top_k(spark):
    r = np.random.default_rng(5)
    vs = [list(map(float, v)) for v in r.normal(0, 1, (300, 12)) * r.pareto(2, (300, 1))]
    rows = [(i, v, 0) for i, v in enumerate(vs)] + [(300, vs[0], 0), (301, None, 0), (302, [None] + vs[1][1:], 0), (303, [float("nan")] * 12, 0), (304, [0.0] * 12, 0), (310, vs[3], 1), (310, vs[3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((x["query_id"], x["rank"], x["score"]) for x in TK.top_k(df, lambda i: i % 10 == 0, 5, per_cell=2, per_group=2, image=12 * 8).collect())
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for n, (i, q) in enumerate(fine):
        if i % 10 == 0:
            best = sorted(((-int(q @ v), j) for m, (j, v) in enumerate(fine) if m != n))[:5]
            want += [(i, k + 1, -s) for k, (s, _) in enumerate(best)]
    assert got == sorted(want)
    assert TK.top_k(df.limit(0), lambda i: i % 10 == 0).count() == 0
    odd = df.selectExpr("*", "vec_id as id", "vec_id as row", "vec_id as v", "vec_id as score", "vec_id as group", "vec_id as cell")
    assert TK.top_k(odd, lambda i: i % 10 == 0, 5).count() == len(got)


@pytest.mark.parametrize("size", (1e6, 1e9))
def test_top_k_of_large_components(spark, size):
    r = np.random.default_rng(6)
    whole = [[int(x) for x in v] for v in r.integers(-size, size, (120, 8))] + [[int(size) + 1] * 8, [int(size)] * 8, [int(size) - 1] * 8]
    whole += [whole[0], whole[120]]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in enumerate(whole)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, TK.top_k(df, lambda i: i % 10 == 0, 5, image=8 * 16).select("query_id", "rank", "vec_id", "score").collect()))
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for i, q in enumerate(whole):
        if i % 10 == 0:
            best = sorted((-limit(sum(a * b for a, b in zip(q, v))), j) for j, v in enumerate(whole) if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_pruning_keeps_all_candidates():
    r = np.random.default_rng(7)
    v = np.floor(r.normal(0, 50, (400, 6)) * np.array([8, 1, 1, 1, 1, 1]))
    bucket = TK.Bucket(np.arange(400), np.arange(400), v.astype(np.int64))
    q = np.floor(r.normal(0, 50, (40, 6)) * np.array([8, 1, 1, 1, 1, 1]))
    norms, scores = np.sqrt((q * q).sum(axis=1)), q @ bucket.v.T
    for share in (0.2, 0.9, 0.999):
        bounds = np.quantile(scores, share, axis=1)
        may = TK.candidates(bucket, q, norms, bounds)
        assert may[scores >= bounds[:, None]].all() and (share < 0.9 or may.mean() < 0.8)


# 8. quality
def test_features_do_not_depend_on_neighbours():
    net = QU.Network()
    texts = [prose(9, n).encode() for n in (1, 40, 200)] + [b"", b"x" * 128, b"y" * 129]
    together = net.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for t, f in zip(texts, together):
        alone = net.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], f, atol=1e-4)


def test_quality_held_out(spark):
    from driftline.llm.queries import op8_quality, table

    d = "/root/testdata/sf0.1"
    rows = op8_quality(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in QU.score_quality(odd, labels).collect()} == {1.0}
    assert {r["score"] for r in QU.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert QU.score_quality(none, labels).count() == 0


def test_network_equals_plain_loops():
    net = QU.Network(3).round()
    texts = [prose(9, n).encode() for n in (1, 12, 90)] + [b"", b"x" * 128, b"y" * 129, "é日本".encode() * 40]
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    step = QU.GROUP * QU.HALF
    for text, score in zip(texts, got):
        halves = max(1, -(-len(text) // step))
        padded = text + b"\0" * ((halves * step + QU.GROUP) - len(text))
        response = np.zeros((halves * QU.HALF, QU.FILTERS))
        for s in range(halves * QU.HALF):
            for w, part in ((net.first, padded[s * QU.GROUP : (s + 1) * QU.GROUP]), (net.second, padded[(s + 1) * QU.GROUP : (s + 2) * QU.GROUP])):
                e = np.concatenate([net.embed[b] for b in part]).astype(float)
                response[s] += [sum(e[k] * float(w[k, f]) for k in range(len(e))) for f in range(QU.FILTERS)]
        chunks = [response[c * QU.HALF : (c + 2) * QU.HALF] for c in range(max(1, halves - 1))]
        pooled = np.mean([np.maximum(c.max(axis=0) + net.bias, 0) for c in chunks], axis=0)
        assert abs(score - 1 / (1 + np.exp(-(pooled @ net.weight + net.offset[0])))) < 1e-9


def test_scores_do_not_depend_on_the_batch():
    net, r = QU.Network(4).round(), np.random.default_rng(9)
    text = prose(10, 300).encode()
    seen = set()
    for n in range(40):
        others = [prose(int(x), 5 + n).encode() for x in r.integers(0, 1000, n)]
        texts = others[: n // 2] + [text] + others[n // 2 :]
        seen.add(net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))[n // 2])
    assert len(seen) == 1


def test_quality_sample_ignores_labels_without_documents(spark):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(10)] + [(3, "x " * 5000), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000, 8000)] + [(i, i % 2) for i in range(10)], "doc_id long, quality int")
    slim, y = docs.withColumnRenamed("doc_id", "id"), labels.selectExpr("doc_id as id", "quality as y")
    assert len(QU.sample(slim, y, "y", 50, 1 << 20)) == 11
    assert [len(t) for t, c in QU.sample(slim, y, "y", 50, 400) if c == 1] != []
    assert sum(len(t) for t, c in QU.sample(slim, y, "y", 50, 900) if c == 0) <= 900
    assert len(QU.sample(slim, y, "y", 2, 1 << 20)) == 4


# 9. decontamination
def test_decontamination(spark, odd, none):
    long = prose(20, 25)
    bench = spark.createDataFrame([(1, long), (2, "Alpha, beta!"), (3, None), (4, "..."), (None, prose(21, 12)), (5, long)], "item_id long, text string")
    w = long.split()
    docs = [(1, "x " + ", ".join(w[3:15]).upper() + " y", None, None, 0, ""), (2, "see ALPHA beta here alpha. Beta", None, None, 0, ""), (3, " ".join(w[:9]), None, None, 0, ""), (4, prose(21, 12), None, None, 0, ""), (5, None, None, None, 0, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    for bound in (DC.PER_SET, 2):  # one set, and several
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in DC.annotate(df, bench, per_set=bound).collect()}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got == {1: (14, 12, 2, sha("1,5"), True), 2: (6, 4, 1, sha("2"), True), 3: (9, 0, 0, sha(""), False), 4: (12, 12, 0, sha(""), True), 5: (0, 0, 0, sha(""), False)}
        assert {r["doc_id"] for r in DC.decontaminate(df, bench, per_set=bound).collect()} == {3, 5}
    cut = {r["doc_id"]: r["text"] for r in DC.decontaminate(df, bench, mode="spans").collect()}
    assert cut[1].split() == ["x", "y"] and cut[2].split() == ["see", "here"] and cut[3] == docs[2][1] and cut[5] is None
    assert DC.annotate(odd, bench).count() == len(ODD) and DC.annotate(none, bench).count() == 0
    assert DC.annotate(df, bench.limit(0)).where("contaminated").count() == 0


# 10. near duplicates
def brute_classes(rows, k=5, similarity=0.8):
    pat = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    words = [tuple(pat.findall((r[1] or "").translate({c: c + 32 for c in range(65, 91)}))) for r in rows]
    sets = [{w[i : i + k] for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    name = {}
    for i, r in enumerate(rows):
        name[root(i)] = min((x for x in (name.get(root(i)), r[0]) if x is not None), default=None)
    return Counter((r[0], name[root(i)], links[i]) for i, r in enumerate(rows))


def near_copies(n, seed=30):
    r = np.random.default_rng(seed)
    base, out = prose(seed, 120).split(), []
    for i in range(n):
        w = list(base)
        for at in r.integers(0, len(w), r.integers(0, 3)):
            w[at] = f"edit{r.integers(0, 10**6)}"
        out.append((1000 + i, " ".join(w), None, None, 0, ""))
    return out


def test_join_equals_brute_force(spark, odd, none, monkeypatch):
    rows = near_copies(60) + near_copies(25, 31) + [(i, prose(40, 80) + " " + prose(i, 20), None, None, 0, "") for i in range(100, 160)] + ODD + [(900, "one two", None, None, 0, ""), (901, "One, TWO", None, None, 0, "")]
    for leaf, block in ((96, 512), (6, 16)):  # also with large nodes and components of many blocks
        monkeypatch.setattr(NJ, "LEAF", leaf)
        monkeypatch.setattr(NJ, "BLOCK", block)
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in NJ.similar_classes(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == brute_classes(rows)
    assert NJ.similar_classes(none).count() == 0
    kept = NJ.one_per_class(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, None, 5, 6, 7, 8])


def test_join_tells_rows_of_one_id_apart(spark):
    a, b = prose(50, 60), prose(51, 60)
    rows = [(3, a), (5, a + " more"), (5, b), (None, b + " more"), (None, a), (None, prose(52, 60)), (None, prose(52, 60)), (9, prose(53, 60)), (9, prose(54, 60))]
    rows = [(i, t, "en", "s", 1, "k") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, th string, doc long, own string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in NJ.similar_classes(df).collect())
    assert got == brute_classes(rows)
    kept = NJ.one_per_class(df)
    assert kept.columns == df.columns
    # of each class one row stays, and never two of one text
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(3, a), (5, b), (0, prose(52, 60)), (9, prose(53, 60)), (9, prose(54, 60))])


def test_runs_follow_the_target_recall():
    assert NJ.runs_needed(0.8, 0.9) < NJ.runs_needed(0.8, 0.9999) <= 5


# Columns of any name
CLASHING = "copies taken row uid doc id th hash own again gone kept n_lines n_dropped tid body hits pos k h words window head size gid part local shard cell rank base node links host rule action name x y picked _id _th score langs lang_pred gain c0 c1 key used linked rid sig n comp blocks rep rep_th".split()


def test_columns_of_any_name(spark):
    rows = [(i, prose(i % 4, 30), "en", "ab"[i % 2], "http://a.com/x", f"<p>{i}</p>") for i in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, html string")
    docs = plain.selectExpr("*", *[f"doc_id * 0 + {n} as `{c}`" for n, c in enumerate(CLASHING)])
    labels = spark.createDataFrame([(i, i % 2, 7) for i in range(12)], "doc_id long, quality int, y int")
    bench = spark.createDataFrame([(1, prose(2, 30), 1)], "item_id long, text string, words int")
    rules = spark.createDataFrame([("block", "a.com", "/x")], "action string, host string, path string")
    runs = {
        "mix": lambda d: MX.mix(d).select("doc_id", "copies"),
        "shard": lambda d: SH.shard(d).select("doc_id", "shard"),
        "lines": lambda d: LD.dedup_lines(d, 3).select("doc_id", "n_dropped", "kept"),
        "url": lambda d: UF.judge(d, rules, id_col="doc_id"),
        "language": lambda d: LI.predict_languages(d),
        "quality": lambda d: QU.score_quality(d, labels),
        "bench": lambda d: DC.annotate(d, bench),
        "join": lambda d: NJ.similar_classes(d),
    }
    for name, run in runs.items():
        assert Counter(map(tuple, run(docs).collect())) == Counter(map(tuple, run(plain).collect())), name
    for whole in (MX.apply_mix, NJ.one_per_class, LI.accepted, lambda d: DC.decontaminate(d, bench), lambda d: DC.decontaminate(d, bench, mode="spans")):
        got, want = whole(docs), whole(plain)
        assert got.columns == docs.columns and Counter(map(tuple, got.select(plain.columns).collect())) == Counter(map(tuple, want.collect()))


def test_tokens_and_top_k_with_columns_of_any_name(spark):
    P = pytest.importorskip("public_tokenizers")
    names = ["id", "ids", "row", "rows", "image", "len", "v", "n", "no", "start", "n_tokens", "part", "nth", "longest", "score", "rank", "query_id"]
    docs = spark.createDataFrame([(i, prose(i, 9)) for i in range(12)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, -i / 7]) for i in range(30)], "vec_id long, embedding array<double>")
    runs = {
        "tokens": (docs, "doc_id", lambda d: TO.read_tokens(*TO.write_tokens(d, P.path("byte_bpe_50k.json")))),
        "top k": (vectors, "vec_id", lambda d: TK.top_k(d, lambda i: i % 10 == 0)),
    }
    for name, (plain, key, run) in runs.items():
        extra = plain.selectExpr("*", *[f"{key} * 0 + {n} as `{c}`" for n, c in enumerate(names)])
        assert Counter(map(tuple, run(extra).collect())) == Counter(map(tuple, run(plain).collect())), name


def test_a_text_longer_than_a_segment_keeps_all_its_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    r = np.random.default_rng(3)
    text = " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, 20, 420_000), r.integers(0, 5000, 420_000)))
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]
    assert len(ids) > 1 << 20 and len(text) > 2 << 20  # more than a segment, and than a slab
    rows = [(1, "a"), (2, text), (3, None)]
    got = {g["doc_id"]: g for g in TO.read_tokens(*TO.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)).collect()}
    assert (got[2]["n_tokens"], got[2]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert got[3]["start"] == got[2]["start"] + len(ids) and got[3]["n_tokens"] == 1


def test_shards_are_merged_in_levels(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for wide in (1024, 4):
        got = SH.shard(df, per_task=10, wide=wide).collect()
        load, of = Counter(), {}
        for r in got:
            load[r["shard"]] += r["size"]
            assert of.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        assert len(got) == 600 and max(load.values()) - min(load.values()) <= 400


def test_every_link_of_a_page_counts(spark):
    rules = spark.createDataFrame([("block", "a.com", "/bad"), ("block", "b.com", "/q?x=1&y=2"), ("block", "b.com", "/q")], "action string, host string, path string")
    pages = [
        (1, "http://c.com/1", '<link rel="x canonical" href="http://c.com/ok"><link rel=canonical href="http://a.com/bad">'),
        (2, "http://c.com/2", '<link rel="canonical" href="http://b.com/q?x=1&amp;y=2">'),
        (3, "http://c.com/3", '<link rel="noncanonical" href="http://a.com/bad">'),
        (4, "http://c.com/4", "<meta http-equiv=refresh content='0; url=http://c.com/ok'>"),
    ]
    pages += [(10, "http://a.com/bad", None), (11, "http://b.com/q?x=1&y=2", None)]
    got = {r["page_id"]: r["verdict"] for r in UF.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 10: "block", 11: "block"}


RELATIVE = [
    ("https://a.com/x/p1.html", "<link rel=canonical href='page2.html'>", "a.com/x/page2.html"),
    ("https://a.com/x/p2?id=1", "<link rel=canonical href='?id=3'>", "a.com/x/p2?id=3"),
    ("https://a.com/x/y/p3", "<link rel=canonical href='../z/./q?u=http://b/c'>", "a.com/x/z/q?u=http://b/c"),
    ("https://a.com", "<link rel=canonical href='p4'>", "a.com/p4"),
    ("https://a.com/x/p5", "<link rel=canonical href='../../..'>", "a.com/"),
    ("https://a.com/x/p6", "<link rel=canonical href='#top'>", "a.com/x/p6"),
    ("https://a.com/x/p7", "<link rel=canonical href='mailto:me'>", None),
    ("https://a.com/x/p8", """<meta http-equiv=refresh content="0; url='https://B.com/b'">""", "b.com/b"),
    ("https://a.com/x/p9", """<meta http-equiv="refresh" content='3;URL="next"'>""", "a.com/x/next"),
    ("https://a.com/x/p10", "<meta http-equiv=refresh content=5>", None),
    ("https://a.com/x/p11", "<link rel=canonical href='/r'>", "a.com/r"),
]


def test_relative_links_and_quoted_refreshes(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(RELATIVE)], "page_id long, url string, html string")
    links = pages.select("page_id", F.transform(UF.linked_urls(F.col("url"), F.col("html")), UF.alias_key).alias("links"))
    assert {r["page_id"]: r["links"] for r in links.collect()} == {i: [w] if w else [] for i, (_, _, w) in enumerate(RELATIVE)}
    rules = spark.createDataFrame([("block", "a.com", "/x/page2"), ("block", "b.com", "/b")], "action string, host string, path string")
    more = pages.union(spark.createDataFrame([(90, "https://a.com/x/page2.html", ""), (91, "http://b.com/b", None)], pages.schema))
    assert {r["page_id"] for r in UF.judge(more, rules).where("verdict = 'block'").collect()} == {0, 7, 90, 91}
