"""run() of the pipeline against plain Python versions of its stages."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

from test_operators import brute_classes, prose

import corpus_pipeline


def mixed(rows):
    """Copies of each document: weights 5, 2, 1, half as many words again, twice at most."""
    size = {r[0]: len(r[1].split()) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r[0])
    words = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    target, left, open_ = {}, Fraction(3, 2) * sum(words.values()), set(by)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * words[s]}
        for s in full or open_:
            target[s] = 2 * words[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    out = Counter()
    for s, ids in by.items():
        whole = min(int(target[s] / Fraction(words[s])), 2)
        rest = float(target[s] - whole * words[s])
        taken, f = set(), rest / words[s]
        if rest > 0:
            key = {}
            for i in ids:
                u = (int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48
                key[i] = (u / (1 - u)) / (min(max(size[i] / (words[s] / len(ids)), 0.5), 2.0) * (f / (1 - f)))
            total = 0
            for i in sorted(ids, key=key.get):
                total += size[i]
                if total > rest:
                    break
                taken.add(i)
            for _ in range(2):
                gap = rest - sum(size[i] for i in taken)
                near = [(abs(gap - size[i]), key[i], i) for i in ids if i not in taken and abs(gap - size[i]) < abs(gap)]
                if near:
                    taken.add(min(near)[2])
        for i in ids:
            out[i] = min(whole + (i in taken), 2)
    return +out


def test_run_equals_plain_stages(spark, tmp_path):
    bench = [prose(70, 14), prose(71, 12)]
    rows = [(i, prose(i, 20 + 7 * (i % 5)), "en", "abc"[i % 3], 0) for i in range(30)]
    rows += [(40, rows[3][1], "en", "b", 0), (41, rows[4][1] + " tail", "en", "a", 0), (42, None, None, "a", 0), (43, "12 34 !", "en", "c", 0), (44, "", "en", "c", 0)]
    rows += [(50, f"{prose(80, 9)} {bench[0]} end", "en", "a", 0), (51, " ".join(bench[1].split()[:9]) + " other words here", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {doc for doc, name, _ in brute_classes(known) if doc == name}
    windows = lambda t: {tuple(w[i : i + 10]) for w in [re.findall(r"[0-9a-z]+", t.lower())] for i in range(len(w) - 9)}
    tests = set().union(*map(windows, bench))
    clean = [r for r in known if r[0] in first and not windows(r[1]) & tests]
    assert {r[0] for r in rows} - {r[0] for r in clean} == {40, 41, 42, 43, 44, 50}
    text = {r[0]: r[1] for r in clean}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == mixed(clean)
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 1, zlib.crc32(text[r["doc_id"]].encode())) for r in got)
    slots, of, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of[text[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert set(slots) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in of.values()) and max(load.values()) - min(load[k] for k in range(8)) <= 2 * max(r["size"] for r in got)
