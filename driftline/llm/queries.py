"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table.  SQL stands beside those that SQL
can express; tests compare the others with brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import annotate

    return annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS win
  FROM (SELECT item, words, least(len(words), 10) AS k, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)
), dw AS (
  SELECT uid, i, k, array_to_string(words[i:i + k - 1], ' ') AS win
  FROM (SELECT uid, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(words) >= k)
), hit AS (
  SELECT uid, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k
), n AS (
  SELECT uid, count(DISTINCT pos) AS n_hit FROM (SELECT uid, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY uid
), it AS (
  SELECT uid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT uid, item FROM hit WHERE item IS NOT NULL) GROUP BY uid
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (uid) LEFT JOIN it USING (uid)
"""

def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    m = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=(3, 2), most=2)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP1_SQL = r"""
WITH s AS (
  SELECT row_number() OVER () AS uid, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN doc_id IS NULL THEN 'null' || md5(coalesce(text, '')) END AS nameless
  FROM documents
), t0 AS (
  SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS words FROM s GROUP BY source
), t1 AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM t0
), t2 AS (
  SELECT *, CAST(sum(words) OVER () AS BIGINT) * 3
            - CAST(coalesce(sum(words) OVER (ORDER BY words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 4 AS rest,
         CAST(sum(w) OVER (ORDER BY words / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) * 2 AS per
  FROM t1
), level AS (
  SELECT rest AS lrest, per AS lper FROM t2 WHERE rest <= words * 2 * per / w ORDER BY words / w, source NULLS LAST LIMIT 1
), t3 AS (
  SELECT source, n, words, CASE WHEN lper IS NULL THEN CAST(words * 2 AS DOUBLE)
         ELSE least(CAST(w * lrest AS DOUBLE) / CAST(lper AS DOUBLE), CAST(words * 2 AS DOUBLE)) END AS target
  FROM t2 LEFT JOIN level ON TRUE
), r0 AS (
  SELECT s.*, t3.n, t3.words, t3.target,
         CASE WHEN words > 0 THEN least(CAST(floor(target / words) AS BIGINT), 2) ELSE 0 END AS whole,
         (CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), nameless)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM s JOIN t3 ON s.source IS NOT DISTINCT FROM t3.source
), r1 AS (
  SELECT *, greatest(target - whole * words, 0.0) AS rest FROM r0
), r2 AS (
  SELECT *, CASE WHEN rest > 0 AND size > 0 THEN
    (u / (1 - u)) / (least(greatest(size / (words / n), 0.5), 2.0) * ((rest / words) / (1 - rest / words))) END AS key
  FROM r1
), r3 AS (
  SELECT uid, source, size, key, rest, doc_id, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, uid ROWS UNBOUNDED PRECEDING) <= rest AS inn
  FROM r2 WHERE key IS NOT NULL
), g1 AS (
  SELECT source, any_value(rest) - coalesce(sum(CASE WHEN inn THEN size END), 0) AS gap FROM r3 GROUP BY source
), f1 AS (
  SELECT uid AS pick FROM (SELECT r3.uid, row_number() OVER (PARTITION BY r3.source ORDER BY abs(gap - size), key, doc_id, uid) AS k
    FROM r3 JOIN g1 ON r3.source IS NOT DISTINCT FROM g1.source WHERE NOT inn AND abs(gap - size) < abs(gap)) WHERE k = 1
), r4 AS (
  SELECT r3.* REPLACE (inn OR pick IS NOT NULL AS inn) FROM r3 LEFT JOIN f1 ON uid = pick
), g2 AS (
  SELECT source, any_value(rest) - coalesce(sum(CASE WHEN inn THEN size END), 0) AS gap FROM r4 GROUP BY source
), f2 AS (
  SELECT uid AS pick2 FROM (SELECT r4.uid, row_number() OVER (PARTITION BY r4.source ORDER BY abs(gap - size), key, doc_id, uid) AS k
    FROM r4 JOIN g2 ON r4.source IS NOT DISTINCT FROM g2.source WHERE NOT inn AND abs(gap - size) < abs(gap)) WHERE k = 1
), d AS (
  SELECT uid AS drawn FROM r4 LEFT JOIN f2 ON uid = pick2 WHERE inn OR pick2 IS NOT NULL
)
SELECT doc_id, size, words AS source_size, target,
       size * least(whole + CASE WHEN drawn IS NOT NULL THEN 1 ELSE 0 END, 2) AS taken,
       least(whole + CASE WHEN drawn IS NOT NULL THEN 1 ELSE 0 END, 2) AS copies
FROM r1 LEFT JOIN d ON uid = drawn
"""

def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT uid, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT uid) >= 10),
j AS (SELECT uid, count(*) AS n_lines, sum(CASE WHEN f.key IS NULL THEN 0 ELSE 1 END) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '') AS kept
      FROM k LEFT JOIN f ON k.key = f.key GROUP BY uid)
SELECT doc_id, n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN j USING (uid)
"""

#: Fixed by the query's contract: action, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP4_SQL = r"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS uid, page_id, url, html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT uid, page_id, url, html, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS query FROM p
), rules(action, h, pa) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT uid, h || pa AS rule, action, row_number() OVER (PARTITION BY uid ORDER BY length(h || pa) DESC) AS k
  FROM q JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, pa)
), r AS (
  SELECT q.*, rule, action, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node
  FROM q LEFT JOIN (SELECT * FROM fit WHERE k = 1) f USING (uid)
), named AS (
  SELECT node, host, regexp_extract(url, '^(.*?)://', 1) AS scheme, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*([^"''\s>]+)', 1)]) AS l FROM r WHERE node IS NOT NULL AND html IS NOT NULL
), absolute AS (
  SELECT node, CASE WHEN strpos(l, '://') > 0 THEN substr(l, strpos(l, '://') + 3) WHEN starts_with(l, '//') THEN substr(l, 3) WHEN starts_with(l, '/') THEN host || l END AS a FROM named WHERE l <> ''
), e AS (
  SELECT node AS a, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || CASE WHEN regexp_extract(a, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(a, '^[^/?#]*([^?#]*)', 1) END
         || regexp_extract(a, '^[^?#]*(\?[^#]*)?', 1) AS b FROM absolute WHERE a IS NOT NULL
), pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
cls AS (SELECT reach.a AS node, max(CASE WHEN action = 'allow' THEN 1 ELSE 0 END) AS allowed FROM reach JOIN r ON r.node = reach.b AND action IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN allowed = 1 THEN 'allow' WHEN allowed = 0 THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN cls USING (node)
"""

def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_languages

    return predict_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import read_tokens, write_tokens

    files, folder = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(files, folder)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


OP7_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding) AS x FROM embeddings
), ok AS (
  SELECT r, vec_id FROM v WHERE vec_id IS NOT NULL GROUP BY r, vec_id HAVING count(*) = count(x) AND bool_and(isfinite(CAST(x AS DOUBLE)))
), i AS (
  SELECT r, vec_id, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS n FROM v JOIN ok USING (r, vec_id)
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id, CAST(sum(q.n * c.n) AS BIGINT) AS score
  FROM i q JOIN i c ON q.d = c.d AND q.r <> c.r WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, cr) AS rank FROM s) WHERE rank <= 5
"""

def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_classes

    return similar_classes(table(spark, sf_dir, "documents"), k=5, similarity=0.8)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
  FROM documents
), i AS (
  SELECT no, item_id, unnest(list_distinct(words)) AS term
  FROM (SELECT row_number() OVER () AS no, item_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM benchmark)
), s AS (
  SELECT CAST(count(*) FILTER (len(words) > 0) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d
), tf AS (
  SELECT uid, doc_id, n, term, count(*) AS tf
  FROM (SELECT uid, doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs
), sc AS (
  SELECT no, item_id, uid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST, uid) AS rank FROM sc WHERE score > 0) WHERE rank <= 10
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import audit

    return audit(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"])


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, coalesce('s' || source, 'n') AS tree,
         list_aggregate([coalesce(strlen(v) || ':' || v, '-') FOR v IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)]], 'string_agg', '') AS head,
         -- crc32, bit by bit
         list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda p: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(p AS INTEGER), 1)) AS BIGINT)),
           lambda c, b: list_reduce(range(8), lambda y, k: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295) AS crc
  FROM documents
), l AS (
  SELECT row_number() OVER () AS uid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, uid) - 1 AS pos FROM l
), up AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM r GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, [sha256(array_to_string(nodes[3 * p + 1:3 * p + 3], '')) FOR p IN range((len(nodes) + 2) // 3)] FROM up WHERE len(nodes) > 1
), top AS (
  SELECT tree, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE len(nodes) = 1
), over AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM top
  UNION ALL
  SELECT level + 1, [sha256(array_to_string(nodes[3 * p + 1:3 * p + 3], '')) FOR p IN range((len(nodes) + 2) // 3)] FROM over WHERE len(nodes) > 1
), steps AS (
  SELECT tree, level AS step, nodes, CAST(NULL AS BIGINT) AS start FROM up WHERE len(nodes) > 1
  UNION ALL
  SELECT tree, height + level, nodes, CASE WHEN level = 0 THEN place END FROM top, over WHERE len(nodes) > 1
), walk AS (
  SELECT uid, tree, 0 AS step, pos * 3 AS spot, coalesce(changed, leaf) AS cur, '' AS proof FROM r
  UNION ALL
  SELECT uid, tree, step + 1, spot, sha256(l || cur || g), proof || l || g
  FROM (SELECT uid, w.tree, w.step, cur, proof, coalesce(start, spot // 3) AS spot,
               array_to_string(nodes[coalesce(start, spot // 3) // 3 * 3 + 1:coalesce(start, spot // 3)], '') AS l,
               array_to_string(nodes[coalesce(start, spot // 3) + 2:coalesce(start, spot // 3) // 3 * 3 + 3], '') AS g
        FROM walk w JOIN steps s ON w.tree = s.tree AND w.step = s.step)
), fin AS (
  SELECT uid, arg_max(cur, step) AS folded, arg_max(proof, step) AS proof FROM walk GROUP BY uid
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM r JOIN fin USING (uid) JOIN top USING (tree), (SELECT nodes[1] AS root FROM over WHERE len(nodes) = 1)
"""


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import linked

    return linked(table(spark, sf_dir, "embeddings"), cosine=0.9)


OP13_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT r, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), p AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach(a, c) AS (
  SELECT r, vec_id FROM v UNION SELECT p.a, reach.c FROM p JOIN reach ON p.b = reach.a
), comp AS (SELECT a AS r, min(c) AS component_id FROM reach GROUP BY a),
links AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN links USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard_by_bytes": op2_shard_by_bytes,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_token_output": op6_token_output,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_dedup": op13_vector_dedup,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_vector_dedup": OP13_SQL,
}
