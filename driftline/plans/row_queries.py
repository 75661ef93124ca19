"""Queries of envelopes, mutations, catalogs, selections and streams."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import apply as A
from driftline.operators import catalog as K
from driftline.operators import decode as D
from driftline.operators import graph as G
from driftline.operators import mutations as M
from driftline.plans import fixtures as X
from driftline.plans.cell_queries import WON
from driftline.sources import tables as T
from driftline.sources.scratch import shared_folder, stage
from driftline.streaming import keyed as Y
from driftline.streaming import replicate as R
from driftline.streaming.bucketed import BucketedLog

NOW = X.NOW
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Envelopes: one per (user_id, event_type).  b: base columns that results are
# checked against; the JSON is built from them and decoded again.
BASE = """b AS (SELECT user_id AS pk, event_type AS ck, max(event_id) AS mx, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi, min(epoch_us(ts)) // 1000000 AS base, 60 + max(event_id) % 100 AS dur FROM events GROUP BY 1, 2),
tg AS (SELECT user_id AS pk, event_type AS ck, event_id % 5 AS tag, max(epoch_us(ts)) AS twt FROM events GROUP BY 1, 2, 3)"""
KINDS = {"pk": "partition_key", "ck": "clustering", "val": "regular", "note": "regular", "tags": "regular", "hist": "regular", "props": "regular", "region": "static"}
CLASSES = {"val": "simple", "note": "simple", "tags": "set", "hist": "list", "props": "udt", "region": "simple"}


def envelopes(s, d):
    e = X.table(s, d, "events").select(F.col("user_id").alias("pk"), F.col("event_type").alias("ck"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("wt"))
    tags = e.groupBy("pk", "ck", F.expr("event_id % 5").alias("tag")).agg(F.max("wt").alias("twt"), F.max("event_id").alias("mx"), F.min("wt").alias("lo"))
    b = tags.groupBy("pk", "ck").agg(F.max("mx").alias("mx"), F.min("lo").alias("lo"), F.max("twt").alias("hi"), F.array_sort(F.collect_list(F.struct("tag", "twt"))).alias("tg"))
    # what is decoded costs more than its bytes say: every core takes a part
    b = b.repartition(s.sparkContext.defaultParallelism, "pk", "ck")
    return b.withColumn("base", F.expr("lo div 1000000")).withColumn("dur", F.expr("60 + mx % 100")).select("pk", "ck", F.expr("""concat(
      '{"pk":', pk, ',"ck":"', ck, '","val":', mx, ',"note":null,"tags":', to_json(tg.tag), ',"hist":[', mx, ',', mx + 1, ',', mx + 2, '],"props":{"k":', mx, ',"e":"x"}',
      ',"region":', if(mx % 6 = 0, '[]', '"r"'),
      ',"__sys_rw_ts":', if(mx % 5 = 0, 'null', cast(lo as string)), ',"__sys_rw_ttl":', if(mx % 3 = 0, concat('[', dur, ',', if(mx % 9 = 0, -base, dur), ']'), 'null'),
      ',"__sys_clts":{"val":', hi, ',"note":null,"tags":', to_json(tg.twt), ',"props":{"k":', hi, ',"e":', lo, '},"region":', if(mx % 6 = 0, 'null', cast(lo as string)), '}',
      ',"__sys_clttl":[', base, ',{', if(mx % 3 = 0, concat('"val":[', dur, ',', dur, '],"hist":[[5,5],[5,5],[6,6]]'), ''), '}]',
      ',"__sys_clts_tmbstn":{', if(mx % 7 = 0, concat('"note":', hi), ''), if(mx % 7 = 0 and mx % 4 = 0, ',', ''), if(mx % 4 = 0, concat('"tags":[', lo - 1, ',{"9":', hi, ',"8":', lo - 5, ',"7":null}]'), ''), '}}')""").alias("json"))


def decoded(s, d):
    return D.decode(envelopes(s, d), NOW)


def plan(s, d):
    return M.plan(decoded(s, d), KINDS, CLASSES, NOW)


B = f"WITH {BASE}"
MEXP = f"CASE WHEN mx % 3 = 0 THEN CASE WHEN mx % 9 = 0 THEN {NOW} + dur ELSE base + dur END END"


@query("scan_envelope", B + " SELECT pk, ck, mx AS val FROM b WHERE mx % 10 <> 7")
def _(s, d):
    path = _folder(s)
    envelopes(s, d).selectExpr("pk", "ck", "case when cast(get_json_object(json, '$.val') as bigint) % 10 <> 7 then json end as json").write.parquet(path)
    return D.decode(T.read_envelopes(s, path), NOW).select("pk", "ck", F.expr("cast(clean['val'] as bigint)").alias("val"))


@query("decode_row_marker", B + " SELECT pk, ck, CASE WHEN mx % 5 <> 0 THEN lo END AS marker_wt FROM b")
def _(s, d):
    return decoded(s, d).select("pk", "ck", F.col("marker.wt").alias("marker_wt"))


@query("decode_row_ttl", B + f" SELECT pk, ck, CASE WHEN mx % 5 <> 0 THEN {MEXP} END AS expiry FROM b")
def _(s, d):
    return decoded(s, d).select("pk", "ck", F.col("marker.expiry").alias("expiry"))


@query("decode_cell_writetimes", B + " SELECT pk, ck, 'val' AS col, hi AS wt FROM b UNION ALL SELECT pk, ck, 'tags', hi FROM b UNION ALL SELECT pk, ck, 'props', hi FROM b UNION ALL SELECT pk, ck, 'note', NULL FROM b UNION ALL SELECT pk, ck, 'region', CASE WHEN mx % 6 <> 0 THEN lo END FROM b")
def _(s, d):
    p = D.parsed(envelopes(s, d)).select("pk", "ck", F.col("writetimes").alias("w"))
    return p.select("pk", "ck", F.explode("w").alias("col", "x")).select("pk", "ck", "col", "x.wt")


@query("decode_cell_ttls", B + " SELECT pk, ck, base + dur AS val_expiry, [base + 5, base + 5, base + 6] AS hist_expiry FROM b WHERE mx % 3 = 0")
def _(s, d):
    p = D.parsed(envelopes(s, d)).select("pk", "ck", F.expr(D.expiries(NOW)).alias("e"))
    return p.where("e.val is not null").select("pk", "ck", F.expr("e.val.expiry").alias("val_expiry"), F.expr("e.hist.elem_expiry").alias("hist_expiry"))


@query("decode_tombstones", B + " SELECT pk, ck, CASE WHEN mx % 7 = 0 THEN hi END AS note_at, CASE WHEN mx % 4 = 0 THEN lo - 1 END AS tags_at, CASE WHEN mx % 4 = 0 THEN 2 END AS tag_keys FROM b WHERE mx % 7 = 0 OR mx % 4 = 0")
def _(s, d):
    return decoded(s, d).where("size(deletions) > 0").select("pk", "ck", F.expr("deletions['note'].deleted_at").alias("note_at"), F.expr("deletions['tags'].coll_deleted_at").alias("tags_at"), F.expr("if(deletions['tags'] is null, null, size(deletions['tags'].keys))").alias("tag_keys"))


@query("cell_divergence", B + f""" SELECT pk, ck, CASE WHEN mx % 5 = 0 THEN TRUE ELSE NOT (hi = lo AND (CASE WHEN mx % 3 = 0 THEN base + dur END) IS NOT DISTINCT FROM ({MEXP})) END AS val_differs FROM b""")
def _(s, d):
    return decoded(s, d).select("pk", "ck", F.map_contains_key("cells", F.lit("val")).alias("val_differs"))


@query("resolve_cell", B + ", n AS (SELECT pk, ck, count(DISTINCT twt) AS n FROM tg GROUP BY 1, 2) SELECT b.pk, b.ck, n > 1 AS tags_mixed, hi <> lo AS props_mixed FROM b JOIN n ON b.pk = n.pk AND b.ck = n.ck")
def _(s, d):
    return decoded(s, d).select("pk", "ck", F.expr("all_cells['tags'].mixed").alias("tags_mixed"), F.expr("all_cells['props'].mixed").alias("props_mixed"))


#: What the n-th of 16 kinds of rows has appended or in its place, and why it
#: is rejected.  {} stands for the row's members.
BROKEN = [
    ("{}", None), ("{} x", "not an object"), ("{} {{}}", "trailing text"), ('{{"__sys_rw_ts":"5"}}', "marker"), ('{{"__sys_rw_ttl":7}}', "ttl pair"), ('{{"__sys_rw_ttl":[5]}}', "ttl pair"),
    ('{{"__sys_rw_ttl":[-1,5]}}', "negative ttl"), ('{{"__sys_clttl":{{"val":[3,4]}}}}', "cell ttl shape"), ('{{"__sys_clttl":["5",{{}}]}}', "cell ttl base"), ('{{"__sys_clttl":[5,{{"val":9}}]}}', "cell ttl detail"),
    ('{{"__sys_clttl":[5,{{"val":["9",4]}}]}}', "cell ttl start"), ('{{"__sys_clttl":[5,{{"val":[[3,4],null]}}]}}', "cell ttl element"), ('{{"__sys_clttl":[5,{{"val":{{"k":3}}}}]}}', "cell ttl field"),
    ('{{"__sys_clttl":[5,{{"val":[3,4,5]}}]}}', "cell ttl pair"), ('{{"__sys_clttl":[5,{{"val":[[3,4],[-3,4]]}}]}}', "negative cell ttl"), ('{{"val":1,"val":2}}', "not an object"),
]


@query("reject_malformed", B + " SELECT pk, ck, [" + ", ".join(f"'{r}'" if r else "NULL" for _, r in BROKEN) + "][mx % 16 + 1] AS reason FROM b WHERE mx % 16 <> 0")
def _(s, d):
    e = envelopes(s, d).withColumn("mx", F.get_json_object("json", "$.val").cast("bigint"))
    texts = F.array(*[F.concat(*[F.col("json") if part is None else F.lit(part) for part in (([None] if t.startswith("{} ") or t == "{}" else []) + [t.removeprefix("{}").replace("{{", "{").replace("}}", "}")])]) for t, _ in BROKEN])
    return D.split_malformed(e.withColumn("json", texts[(F.col("mx") % 16).cast("int")]))[1].select("pk", "ck", "reason")


@query("strip_system_columns", B + " SELECT pk, ck, 8 AS members FROM b")
def _(s, d):
    return decoded(s, d).select("pk", "ck", F.size("clean").alias("members"))


@query("null_absent_containers", B + " SELECT pk, ck, CASE WHEN mx % 6 <> 0 THEN 'r' END AS region FROM b")
def _(s, d):
    return decoded(s, d).select("pk", "ck", F.expr("clean['region']").alias("region"))


@query("split_key_data", B + " SELECT 'key' AS part, 2 * count(*) AS cells FROM b UNION ALL SELECT 'data', 5 * count(*) FROM b UNION ALL SELECT 'unknown', count(*) FROM b")
def _(s, d):
    cols = s.createDataFrame([(c, k) for c, k in KINDS.items() if c != "hist"], "name string, kind string")
    long = decoded(s, d).select("pk", "ck", F.explode("clean").alias("column", "value"))
    out = None
    for name, part in zip(("key", "data", "unknown"), K.split_by_kind(long, cols)):
        one = part.agg(F.count("*").alias("cells")).select(F.lit(name).alias("part"), "cells")
        out = one if out is None else out.union(one)
    return out


@query("join_cell_metadata", B + " SELECT pk, ck, 'val' AS col, hi AS wt FROM b UNION ALL SELECT pk, ck, 'tags', hi FROM b UNION ALL SELECT pk, ck, 'props', hi FROM b")
def _(s, d):
    return D.cell_metadata(decoded(s, d), ["pk", "ck"], ["val", "tags", "props"]).select("pk", "ck", "col", "wt")


def _static_envelopes(s, d):
    e = envelopes(s, d).withColumn("mx", F.get_json_object("json", "$.val").cast("bigint"))
    return e.withColumn("json", F.when(F.col("mx") % 10 == 5, F.regexp_replace("json", r'"ck":"[^"]*"', '"ck":null')).otherwise(F.col("json")))


@query("detect_static_only", B + " SELECT pk, ck, mx % 10 = 5 AS static_only FROM b")
def _(s, d):
    return D.decode(_static_envelopes(s, d), NOW).select("pk", "ck", F.expr("clean['ck'] is null").alias("static_only"))


@query("static_partition_write", B + " SELECT pk, ck, lo AS wt FROM b WHERE mx % 10 = 5 AND mx % 6 <> 0")
def _(s, d):
    m = M.plan(D.decode(_static_envelopes(s, d).where("mx % 10 = 5"), NOW), KINDS, CLASSES, NOW)
    return m.where("is_static and value is not null").select("pk", "ck", "wt")


PLAIN = {"pk": "partition_key", "ck": "clustering", "val": "regular"}


def _plain_plan(s, d):
    # every second row's marker has its cell's writetime
    e = envelopes(s, d).select("pk", "ck", F.expr("""concat('{"pk":', pk, ',"ck":"', ck, '","val":', get_json_object(json, '$.val'), ',"__sys_rw_ts":', get_json_object(json, if(cast(get_json_object(json, '$.val') as bigint) % 2 = 0, '$.__sys_clts.val', '$.__sys_clts.props.e')), ',"__sys_clts":{"val":', get_json_object(json, '$.__sys_clts.val'), '}}')""").alias("json"))
    return M.plan(D.decode(e, NOW), PLAIN, {"val": "simple"}, NOW)


@query("plan_fast_path", B + " SELECT pk, ck, hi AS wt FROM b WHERE hi = lo OR mx % 2 = 0")
def _(s, d):
    return _plain_plan(s, d).where("op = 'full_insert'").select("pk", "ck", "wt")


@query("plan_full_insert", B + " SELECT CASE WHEN hi = lo OR mx % 2 = 0 THEN 'full_insert' ELSE 'baseline' END AS op, count(*) AS n FROM b GROUP BY 1")
def _(s, d):
    return _plain_plan(s, d).where("op in ('full_insert', 'baseline')").groupBy("op").agg(F.count("*").alias("n"))


@query("plan_baseline", B + f" SELECT pk, ck, lo AS wt, {MEXP} AS expiry FROM b WHERE mx % 5 <> 0")
def _(s, d):
    return plan(s, d).where("op = 'baseline'").select("pk", "ck", "wt", "expiry")


@query("plan_tombstone", B + " SELECT pk, ck, hi AS wt FROM b WHERE mx % 7 = 0 OR mx % 5 = 0")
def _(s, d):
    # a deleted cell, or a null of a row that no marker's insert holds
    return plan(s, d).where("column = 'note' and op = 'set_group'").select("pk", "ck", "wt")


@query("plan_key_removals", B + " SELECT pk, ck, '[\"9\"]' AS value, hi AS wt FROM b WHERE mx % 4 = 0")
def _(s, d):
    return plan(s, d).where("op = 'remove'").select("pk", "ck", "value", "wt")


@query("render_removed_keys", B + " SELECT pk, ck, '[\"' || mx || '\",\"a\"]' AS quoted, '[' || mx || ',[1,2]]' AS embedded FROM b")
def _(s, d):
    e = decoded(s, d).select("pk", "ck", F.expr("clean['val']").alias("v"))
    return e.select("pk", "ck", M.removed_keys_json(F.array("v", F.lit("a"))).alias("quoted"), M.removed_keys_json(F.array("v", F.lit("[1,2]")), embedded=True).alias("embedded"))


@query("group_removals_by_ts", B + " SELECT pk, ck, [8, 9] AS keys_, hi AS newest FROM b WHERE mx % 4 = 0")
def _(s, d):
    r = decoded(s, d).where("deletions['tags'] is not null").select("pk", "ck", M.key_removals(F.expr("deletions['tags'].keys"), F.lit(None).cast("bigint")).alias("g"))
    return r.select("pk", "ck", F.expr("array_sort(transform(flatten(g.keys), x -> cast(x as bigint)))").alias("keys_"), F.expr("array_max(g.ts)").alias("newest"))


LISTS = """SELECT pk, ck, 'list_set' AS op, CASE WHEN three THEN '["' || mx || '","' || (mx + 1) || '"]' ELSE '["' || mx || '","' || (mx + 1) || '","' || (mx + 2) || '"]' END AS value FROM r
  UNION ALL SELECT pk, ck, 'list_append', '["' || (mx + 2) || '"]' FROM r WHERE three"""


def _lists(s, d):
    e = decoded(s, d).select("pk", "ck", F.expr("cast(clean['val'] as bigint)").alias("mx"), F.from_json(F.expr("clean['hist']"), "array<string>").alias("items"))
    return e.withColumn("e", F.expr("if(mx % 3 = 0, array(5L, 5L, 6L), array(7L, 7L, 7L))"))


def _list_plan(s, d):
    """Mutations of the lists, which have writetimes and (some) expiries of elements."""
    e = envelopes(s, d).withColumn("json", F.regexp_replace("json", r'"__sys_clts":\{', '"__sys_clts":{"hist":[1,1,1],'))
    return M.plan(D.decode(e, NOW), KINDS, CLASSES, NOW).where("column = 'hist'")


@query("plan_list_runs", B + ", r AS (SELECT *, mx % 3 = 0 AS three FROM b) " + LISTS)
def _(s, d):
    return _list_plan(s, d).select("pk", "ck", "op", "value")


@query("list_timestamps", B + f", r AS (SELECT *, mx % 3 = 0 AS three FROM b) SELECT pk, ck, {NOW * 1_000_000} AS wt FROM r UNION ALL SELECT pk, ck, {NOW * 1_000_000 + 1} FROM r WHERE three")
def _(s, d):
    return _list_plan(s, d).select("pk", "ck", "wt")


@query("list_run_split", B + " SELECT pk, ck, CASE WHEN mx % 3 = 0 THEN 2 ELSE 1 END AS runs FROM b")
def _(s, d):
    return _lists(s, d).select("pk", "ck", F.size(M.list_runs(F.col("items"), F.col("e"))).alias("runs"))


ADD = B + ", g AS (SELECT pk, ck, twt, list_sort(list(tag)) AS tags FROM tg GROUP BY 1, 2, 3), n AS (SELECT pk, ck FROM g GROUP BY 1, 2 HAVING count(*) > 1)"


def _tag_text(row: str = "tags") -> str:
    return f"'[' || array_to_string(list_transform({row}, lambda x: '\"' || x || '\"'), ',') || ']'"


@query("plan_element_adds", ADD + f" SELECT g.pk, g.ck, twt AS wt, {_tag_text()} AS value FROM g JOIN n ON g.pk = n.pk AND g.ck = n.ck")
def _(s, d):
    m = plan(s, d).where("column = 'tags' and op in ('add', 'set_group') and value is not null")
    mixed = m.select("pk", "ck", "op", "wt", "value")
    several = decoded(s, d).where(F.expr("all_cells['tags'].mixed")).select("pk", "ck")
    return mixed.join(several, ["pk", "ck"]).select("pk", "ck", "wt", "value")


@query("elements_by_writetime", ADD + ", o AS (SELECT pk, ck, twt, row_number() OVER (PARTITION BY pk, ck ORDER BY twt) AS nth FROM g) SELECT o.pk, o.ck, nth, twt AS wt FROM o")
def _(s, d):
    e = D.parsed(envelopes(s, d)).select("pk", "ck", F.from_json(F.expr("top['tags']"), "array<string>").alias("t"), F.col("writetimes").alias("w"))
    b = M.element_buckets(F.col("t"), F.expr("w['tags'].elem_wt"), F.expr("transform(w['tags'].elem_wt, x -> cast(null as bigint))"))
    return e.select("pk", "ck", F.posexplode(b).alias("i", "x")).select("pk", "ck", (F.col("i") + 1).cast("bigint").alias("nth"), "x.wt")


@query("plan_element_fallback", B + " SELECT pk, ck, hi AS wt FROM b WHERE mx % 2 = 0")
def _(s, d):
    # one writetime more than elements: the set is written uniformly
    e = envelopes(s, d).where("cast(get_json_object(json, '$.val') as bigint) % 2 = 0")
    e = e.withColumn("json", F.regexp_replace("json", r'("__sys_clts":\{"val":\d+,"note":null,"tags":\[)', "$1 1,"))
    m = M.plan(D.decode(e, NOW), KINDS, CLASSES, NOW).where("column = 'tags' and value is not null")
    return m.where("op = 'set_group'").select("pk", "ck", "wt")


@query("plan_collection_delete", B + ", f AS (SELECT pk, ck, min(twt) AS m, count(DISTINCT twt) AS n FROM tg GROUP BY 1, 2) SELECT b.pk, b.ck, lo AS wt FROM b JOIN f ON b.pk = f.pk AND b.ck = f.ck WHERE mx % 4 = 0 AND n > 1 AND lo - 1 <> m - 1")
def _(s, d):
    return plan(s, d).where("column = 'tags' and op = 'set_group' and value is null").select("pk", "ck", "wt")


@query("plan_udt_fields", B + " SELECT pk, ck, path, CASE WHEN path = 'k' THEN hi ELSE lo END AS wt FROM b, (VALUES ('k'), ('e')) v(path) WHERE hi <> lo")
def _(s, d):
    return plan(s, d).where("op = 'field'").select("pk", "ck", "path", "wt")


@query("plan_groups", B + f""" , c AS (SELECT pk, ck, 'note' AS col, hi AS wt, CAST(NULL AS BIGINT) AS expiry FROM b WHERE mx % 7 = 0 OR mx % 5 = 0
  UNION ALL SELECT pk, ck, 'val', hi, CASE WHEN mx % 3 = 0 THEN base + dur END FROM b WHERE mx % 5 = 0 OR hi <> lo OR (CASE WHEN mx % 3 = 0 THEN base + dur END) IS DISTINCT FROM ({MEXP}))
  SELECT pk, ck, wt, expiry, array_to_string(list_sort(list(col)), ',') AS columns FROM c GROUP BY pk, ck, wt, expiry""")
def _(s, d):
    cells = plan(s, d).where("op <> 'set_group' or column in ('note', 'val')")
    return M.grouped(cells, ["pk", "ck"]).select("pk", "ck", "wt", "expiry", F.array_join("columns", ",").alias("columns"))


def _default_plan(s, d, members: str):
    """Plans of rows without a marker, with ``members`` for their metadata."""
    e = envelopes(s, d).selectExpr("pk", "ck", f"""concat('{{"pk":', pk, ',"ck":"', ck, '","val":', get_json_object(json, '$.val'), ',"note":null,"region":"r"', {members}, '}}') as json""")
    return M.grouped(M.plan(D.decode(e, NOW), KINDS, CLASSES, NOW), ["pk", "ck"]).select("pk", "ck", "wt", "expiry", "is_static", F.array_join("columns", ",").alias("columns"))


@query("plan_default_cell", B + " SELECT pk, ck, hi AS wt, CAST(NULL AS BIGINT) AS expiry, col = 'region' AS is_static, col AS columns FROM b, (VALUES ('note,val'), ('region')) v(col)")
def _(s, d):
    # cells without metadata take the row's newest time
    return _default_plan(s, d, """',"__sys_clts":{"region":', get_json_object(json, '$.__sys_clts.val'), '}'""")


@query("default_metadata", B + f" SELECT pk, ck, {NOW * 1_000_000} AS wt, CAST(NULL AS BIGINT) AS expiry, col = 'region' AS is_static, col AS columns FROM b, (VALUES ('note,val'), ('region')) v(col)")
def _(s, d):
    return _default_plan(s, d, "''")


@query("row_deletes", B + " SELECT pk, ck, lo + 1 AS wt, 'row_delete' AS op FROM b WHERE mx % 4 = 1")
def _(s, d):
    return M.plan(D.decode(_with_row_deletes(s, d), NOW), KINDS, CLASSES, NOW).where("op = 'row_delete'").select("pk", "ck", "wt", "op")


def _with_row_deletes(s, d):
    return envelopes(s, d).withColumn("json", F.expr("""if(cast(get_json_object(json, '$.val') as bigint) % 4 = 1, concat('{"__sys_rw_tmbstn":', cast(get_json_object(json, '$.__sys_clts.props.e') as bigint) + 1, ',', substring(json, 2)), json)"""))


def _atoms(s, d):
    m = M.plan(D.decode(_with_row_deletes(s, d), NOW), KINDS, CLASSES, NOW)
    return A.atoms(m, ["pk", "ck"], CLASSES, ["ck"], ["region"])


# What the envelopes say, cell by cell: n: whether a set's elements differ in
# writetime; marker: a row's marker expiry; gone: until when a row is deleted.
STATE = B + f""", n AS (SELECT pk, ck, count(DISTINCT twt) AS n FROM tg GROUP BY 1, 2),
f AS (SELECT b.*, n, CASE WHEN mx % 5 <> 0 THEN {MEXP} END AS mexp, CASE WHEN mx % 4 = 1 THEN lo + 1 ELSE -1 END AS gone FROM b JOIN n ON b.pk = n.pk AND b.ck = n.ck),
c AS (
  SELECT pk, ck, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS value, lo AS wt, mexp AS expiry, FALSE AS del, gone FROM f WHERE mx % 5 <> 0
  UNION ALL SELECT pk, ck, 'val', '', CAST(mx AS VARCHAR), hi, CASE WHEN mx % 3 = 0 THEN base + dur END, FALSE, gone FROM f
  UNION ALL SELECT pk, ck, 'note', '', NULL, CASE WHEN mx % 7 = 0 OR mx % 5 = 0 THEN hi ELSE lo END, NULL, TRUE, gone FROM f
  UNION ALL SELECT f.pk, f.ck, 'tags', CAST(tag AS VARCHAR), NULL, twt, CASE WHEN n = 1 THEN mexp END, FALSE, gone FROM f JOIN tg ON f.pk = tg.pk AND f.ck = tg.ck
  UNION ALL SELECT pk, ck, 'tags', '9', NULL, hi, NULL, TRUE, gone FROM f WHERE mx % 4 = 0
  UNION ALL SELECT pk, ck, 'hist', lpad(CAST({NOW * 1_000_000} AS VARCHAR), 20, '0') || '.' || lpad(CAST(i AS VARCHAR), 9, '0'), CAST(mx + i AS VARCHAR), {NOW * 1_000_000}, mexp, FALSE, gone FROM f, (VALUES (0), (1), (2)) v(i)
  UNION ALL SELECT pk, ck, 'props', 'k', CAST(mx AS VARCHAR), hi, CASE WHEN hi = lo THEN mexp END, FALSE, gone FROM f
  UNION ALL SELECT pk, ck, 'props', 'e', 'x', lo, CASE WHEN hi = lo THEN mexp END, FALSE, gone FROM f
), r AS (
  SELECT *, row_number() OVER (PARTITION BY pk ORDER BY wt DESC, del DESC, expiry IS NULL DESC, expiry DESC) AS k
  FROM (SELECT pk, CASE WHEN mx % 6 <> 0 THEN 'r' END AS value, CASE WHEN mx % 6 = 0 AND mx % 5 = 0 THEN hi ELSE lo END AS wt, CASE WHEN mx % 6 <> 0 THEN mexp END AS expiry, mx % 6 = 0 AS del FROM f)
), st AS (
  SELECT pk, ck, "column", path, value, wt, expiry, del FROM c WHERE wt > gone
  UNION ALL SELECT pk, NULL, 'region', '', value, wt, expiry, del FROM r WHERE k = 1
)"""


@query("apply_mutations", STATE + " SELECT * FROM st")
def _(s, d):
    return A.state(_atoms(s, d), ["pk", "ck"])


@query("apply_live_rows", STATE + f""", a AS (SELECT * FROM st WHERE NOT del AND (expiry IS NULL OR expiry > {NOW}))
SELECT pk, ck, max(value) FILTER ("column" = 'val') AS val, max(value) FILTER ("column" = 'note') AS note,
  '[' || string_agg('"' || path || '"', ',' ORDER BY path) FILTER ("column" = 'tags') || ']' AS tags, '[' || string_agg('"' || value || '"', ',' ORDER BY path) FILTER ("column" = 'hist') || ']' AS hist,
  '{{' || string_agg('"' || path || '":"' || value || '"', ',' ORDER BY path) FILTER ("column" = 'props') || '}}' AS props, max(value) FILTER ("column" = 'region') AS region
FROM a GROUP BY pk, ck""")
def _(s, d):
    return A.rows(A.live(A.state(_atoms(s, d), ["pk", "ck"]), NOW), ["pk", "ck"], CLASSES, ["ck"], ["region"])


@query("compact_mutations", STATE + ' SELECT pk, count(*) AS cells, max(wt) AS newest FROM st WHERE NOT del GROUP BY pk')
def _(s, d):
    """The log compacted in two halves and again as one, its deletions collected."""
    # staged: each half would decode and plan all envelopes again
    log, keys = stage(_atoms(s, d), "log"), ["pk", "ck"]
    # atoms of one row in both halves, which meet only in the second compaction
    half = F.pmod(F.xxhash64("scope", "column", "path", "wt"), F.lit(2)) == 0
    both = A.compact(log.where(half), keys).union(A.compact(log.where(~half), keys))
    cells = A.compact(both, keys, horizon=2 * NOW * 1_000_000).where("not del and scope in ('cell', 'marker')")
    return cells.groupBy("pk").agg(F.count("*").alias("cells"), F.max("wt").alias("newest"))


@query("mutation_order", B + " SELECT 'baseline' AS op, 1 AS seq UNION ALL SELECT 'set_group', 2 UNION ALL SELECT 'add', 3 UNION ALL SELECT 'field', 4 UNION ALL SELECT 'remove', 5 UNION ALL SELECT 'list_set', 6")
def _(s, d):
    return plan(s, d).select("op", "seq").distinct()


# Selections and catalogs.
@query("parse_selection", """SELECT c_custkey, pos, keyspace, tbl, valid FROM (SELECT c_custkey, unnest([0, 1, 3]) AS pos, unnest(['k' || c_nationkey, 'My "x" ks', NULL]) AS keyspace, unnest(['*', 'T' || c_custkey, NULL]) AS tbl, unnest([TRUE, TRUE, FALSE]) AS valid FROM customer)""")
def _(s, d):
    lists = X.table(s, d, "customer").select("c_custkey", F.expr("""concat('k', c_nationkey, '.*; "My ""x"" ks"."T', c_custkey, '" , \n bad')""").alias("selection"))
    return K.parse_selection(lists).select("c_custkey", "pos", "keyspace", "tbl", "valid")


SEL = """WITH t AS (SELECT DISTINCT 'k' || c_nationkey AS keyspace, 't' || (c_custkey % 50) AS tbl FROM customer), e AS (SELECT 'k' || n_nationkey AS keyspace, CASE WHEN n_nationkey % 3 = 0 THEN '*' ELSE 't' || n_nationkey END AS tbl, n_nationkey AS pos FROM nation
  UNION ALL SELECT 'k' || n_nationkey, 't1', n_nationkey + 100 FROM nation), x AS (SELECT keyspace, tbl, pos FROM e WHERE tbl <> '*' UNION ALL SELECT e.keyspace, t.tbl, pos FROM e JOIN t ON e.keyspace = t.keyspace WHERE e.tbl = '*')"""


def _selection(s, d):
    t = X.table(s, d, "customer").selectExpr("concat('k', c_nationkey) as keyspace", "concat('t', c_custkey % 50) as tbl").distinct()
    n = X.table(s, d, "nation")
    e = n.selectExpr("concat('k', n_nationkey) as keyspace", "if(n_nationkey % 3 = 0, '*', concat('t', n_nationkey)) as tbl", "n_nationkey as pos")
    return e.union(n.selectExpr("concat('k', n_nationkey)", "'t1'", "n_nationkey + 100")), t


@query("expand_wildcards", SEL + " SELECT keyspace, tbl, min(pos) AS pos FROM x GROUP BY ALL")
def _(s, d):
    return K.expand_wildcards(*_selection(s, d))


@query("dedupe_units", "SELECT 'k' || c_nationkey AS keyspace, c_mktsegment AS tbl, min(c_custkey) AS pos FROM customer GROUP BY ALL")
def _(s, d):
    return K.dedupe_units(X.table(s, d, "customer").selectExpr("concat('k', c_nationkey) as keyspace", "c_mktsegment as tbl", "c_custkey as pos"))


@query("target_clash", "SELECT lower(p_brand) AS target, count(DISTINCT p_name) AS sources FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def _(s, d):
    return K.target_clashes(X.table(s, d, "part").select(F.col("p_name").alias("source"), F.expr("if(p_size % 2 = 0, upper(p_brand), p_brand)").alias("target")))


@query("scan_catalog_tables", "SELECT DISTINCT CASE n_regionkey WHEN 2 THEN 'system_of_mine' ELSE 'k' || n_regionkey END AS keyspace, n_name AS tbl FROM nation WHERE n_regionkey > 1")
def _(s, d):
    t = X.table(s, d, "nation").selectExpr("case n_regionkey when 0 then 'SYSTEM' when 1 then 'system_auth' when 2 then 'system_of_mine' else concat('k', n_regionkey) end as keyspace", "n_name as tbl")
    return K.user_tables(t)


@query("scan_catalog_columns", """SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int', 'clustering', 0, 'desc'), ('nation', 'n_name', 'string', 'regular', -1, 'none'), ('nation', 'n_regionkey', 'int', 'partition_key', 0, 'none')) v(tbl, name, type, kind, position, clustering_order)""")
def _(s, d):
    return K.schema_rows(X.table(s, d, "nation"), "nation", ["n_regionkey"], {"n_nationkey": "desc"})


@query("scan_catalog_tables_customer", "SELECT 'k' || c_nationkey AS keyspace, c_name AS tbl FROM customer WHERE c_nationkey % 5 > 1")
def _(s, d):
    t = X.table(s, d, "customer").selectExpr("case c_nationkey % 5 when 0 then 'SYSTEM' when 1 then 'system_auth' else concat('k', c_nationkey) end as keyspace", "c_name as tbl")
    return K.user_tables(t)


@query("scan_catalog_types", "SELECT p_brand AS type_name, CAST(i - 1 AS INTEGER) AS position, CASE i WHEN 1 THEN 'size' ELSE 'name' END AS field, CASE i WHEN 1 THEN 'int' ELSE 'text' END AS type FROM (SELECT DISTINCT p_brand FROM part), (VALUES (1), (2)) v(i)")
def _(s, d):
    t = X.table(s, d, "part").select(F.col("p_brand").alias("type_name")).distinct()
    return K.type_fields(t.withColumn("field_names", F.array(F.lit("size"), F.lit("name"))).withColumn("field_types", F.array(F.lit("int"), F.lit("text"))))


COLS = """WITH src AS (SELECT 't' || p_partkey AS tbl, CASE i WHEN 1 THEN 'partition_key' WHEN 2 THEN 'clustering' ELSE 'regular' END AS kind, CAST(CASE WHEN i = 3 THEN 0 WHEN i = 4 THEN 1 ELSE 0 END AS INTEGER) AS position, 'c' || i AS name, CASE WHEN i = 2 THEN 'Map< int, text>' ELSE 'text' END AS type, CASE WHEN i <> 2 THEN 'none' WHEN p_partkey % 2 = 0 THEN 'desc' ELSE 'asc' END AS clustering_order FROM part, (VALUES (1), (2), (3), (4)) v(i)),
tgt AS (SELECT tbl, kind, position, CASE WHEN name = 'c1' AND p % 5 = 0 THEN 'other' ELSE upper(name) END AS name, CASE WHEN name = 'c2' AND p % 7 = 0 THEN 'int' ELSE lower(replace(type, ' ', '')) END AS type, CASE WHEN name = 'c2' AND p % 13 = 0 THEN 'ASC' ELSE clustering_order END AS clustering_order FROM (SELECT *, CAST(substr(tbl, 2) AS BIGINT) AS p FROM src) WHERE NOT (name = 'c4' AND p % 3 = 0) AND NOT (name = 'c2' AND p % 11 = 0))"""


def _catalogs(s, d):
    src = X.table(s, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("i")).selectExpr(
        "concat('t', p_partkey) as tbl", "case i when 1 then 'partition_key' when 2 then 'clustering' else 'regular' end as kind", "case when i = 4 then 1 else 0 end as position", "concat('c', i) as name", "if(i = 2, 'Map< int, text>', 'text') as type", "case when i <> 2 then 'none' when p_partkey % 2 = 0 then 'desc' else 'asc' end as clustering_order", "p_partkey as p")
    tgt = src.where("not (name = 'c4' and p % 3 = 0) and not (name = 'c2' and p % 11 = 0)").selectExpr("tbl", "kind", "position", "if(name = 'c1' and p % 5 = 0, 'other', upper(name)) as name", "if(name = 'c2' and p % 7 = 0, 'int', lower(replace(type, ' ', ''))) as type", "if(name = 'c2' and p % 13 = 0, 'ASC', clustering_order) as clustering_order")
    return src.drop("p"), tgt


@query("scan_catalog_columns_part", COLS + " SELECT tbl, name, type, position FROM src")
def _(s, d):
    return _catalogs(s, d)[0].select("tbl", "name", "type", "position")


DIFF = COLS + """, j AS (SELECT coalesce(s.tbl, t.tbl) AS tbl, coalesce(s.kind, t.kind) AS kind, coalesce(s.position, t.position) AS position, s.name AS s_name, lower(replace(s.type, ' ', '')) AS s_type, lower(s.clustering_order) AS s_order, t.name AS t_name, t.type AS t_type, lower(t.clustering_order) AS t_order
  FROM (SELECT * FROM src WHERE kind <> 'regular') s FULL JOIN (SELECT * FROM tgt WHERE kind <> 'regular') t ON s.tbl = t.tbl AND s.kind = t.kind AND s.position = t.position),
 w AS (SELECT tbl, kind, CASE WHEN s_name IS NULL OR t_name IS NULL THEN 'count' WHEN lower(s_name) <> lower(t_name) THEN 'name' WHEN s_type <> t_type THEN 'type' WHEN s_order <> t_order THEN 'order' END AS why FROM j),
 cp AS (SELECT k.tbl, list_sort(coalesce(list(kind || ':' || why) FILTER (WHERE why IS NOT NULL), [])) AS reasons FROM (SELECT DISTINCT tbl FROM src) k LEFT JOIN w ON k.tbl = w.tbl GROUP BY 1)"""


@query("anti_missing_columns", COLS + " SELECT s.tbl, s.name FROM src s WHERE kind = 'regular' AND NOT EXISTS (SELECT 1 FROM tgt t WHERE t.tbl = s.tbl AND lower(t.name) = lower(s.name))")
def _(s, d):
    return K.missing_columns(*_catalogs(s, d)).select("tbl", "name")


@query("full_outer_schema_diff", DIFF + " SELECT * FROM j")
def _(s, d):
    return K.schema_diff(*_catalogs(s, d))


@query("schema_compat", DIFF + " SELECT tbl, array_to_string(reasons, ',') AS reasons FROM cp")
def _(s, d):
    return K.schema_compat(*_catalogs(s, d)).select("tbl", F.array_join("reasons", ",").alias("reasons"))


@query("recon_schema", DIFF + " SELECT tbl, len(reasons) = 0 AS matches FROM cp")
def _(s, d):
    return K.schema_compat(*_catalogs(s, d)).select("tbl", (F.size("reasons") == 0).alias("matches"))


@query("schema_action", DIFF + " SELECT tbl, CASE WHEN CAST(substr(tbl, 2) AS BIGINT) % 4 = 0 THEN 'create' WHEN len(reasons) > 0 AND CAST(substr(tbl, 2) AS BIGINT) % 2 = 1 THEN 'refuse' WHEN len(reasons) > 0 THEN 'recreate' ELSE 'add_missing' END AS action FROM cp")
def _(s, d):
    src, tgt = _catalogs(s, d)
    p = F.substring("tbl", 2, 20).cast("bigint")
    return K.schema_action(K.schema_compat(src, tgt), src.select("tbl").distinct().where(p % 4 != 0).withColumn("has_data", p % 2 == 1))


@query("key_order", COLS + " SELECT tbl, array_to_string(list(name ORDER BY kind DESC, position), ',') AS keys, array_to_string(list(clustering_order ORDER BY kind DESC, position), ',') AS orders FROM src WHERE kind <> 'regular' GROUP BY 1")
def _(s, d):
    return K.key_columns(_catalogs(s, d)[0]).select("tbl", F.array_join("keys", ",").alias("keys"), F.array_join("orders", ",").alias("orders"))


@query("clustered_rows", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS nth FROM lineitem")
def _(s, d):
    # ranks of a window that finds the rows already dealt and in order
    rows = K.clustered(X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], {"l_linenumber": "desc"})
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber").desc())).cast("long"))


@query("evolve_add_columns", "SELECT c_custkey, NULL AS c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def _(s, d):
    c = X.table(s, d, "customer")
    return K.evolve(c.where("c_custkey % 2 = 0").select("c_custkey"), c.where("c_custkey % 2 = 1").select("c_custkey", "c_name"))


EDGES = "SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey // 3 > 0"


def _edges(s, d):
    return X.table(s, d, "part").where("p_partkey div 3 > 0").selectExpr("p_partkey as src", "p_partkey div 3 as dst")


@query("reachable_nodes", f"WITH RECURSIVE e AS ({EDGES}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r")
def _(s, d):
    return K.reachable(_edges(s, d))


@query("dependency_levels", f"WITH RECURSIVE e AS ({EDGES}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, CAST(count(dst) AS INTEGER) AS level FROM n LEFT JOIN r ON node = src GROUP BY 1")
def _(s, d):
    e = _edges(s, d)
    return K.dependency_levels(e, e.selectExpr("src as node").union(e.selectExpr("dst")).distinct())


# Parts that need a third of their number, and some of those that need theirs:
# from 7 in every 100 on, a part and the two above it need each other in turn.
KNOTS = EDGES + " UNION ALL SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 100 IN (7, 8) UNION ALL SELECT p_partkey AS src, p_partkey - 2 AS dst FROM part WHERE p_partkey % 100 = 9"


@query("dependency_cycles", f"""WITH RECURSIVE e AS ({KNOTS}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
  n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
  bad AS (SELECT node FROM c UNION SELECT r.src FROM r JOIN c ON r.dst = c.node),
  p(node, len) AS (SELECT node, 0 FROM n UNION SELECT e.src, p.len + 1 FROM p JOIN e ON e.dst = p.node AND e.src NOT IN (SELECT node FROM bad))
  SELECT n.node, CASE WHEN bad.node IS NULL THEN (SELECT max(len) FROM p WHERE p.node = n.node) END AS level, coalesce(component, n.node) AS component, component IS NOT NULL AS on_cycle
  FROM n LEFT JOIN c USING (node) LEFT JOIN bad USING (node)""")
def _(s, d):
    p = X.table(s, d, "part")
    e = _edges(s, d).union(p.where("p_partkey % 100 in (7, 8)").selectExpr("p_partkey", "p_partkey + 1")).union(p.where("p_partkey % 100 = 9").selectExpr("p_partkey", "p_partkey - 2"))
    return G.dependency_order(e, G.ends(e))


# Sinks and streams: each runs to completion and returns what it has written.
def _folder(s) -> str:
    return f"{shared_folder(s)}/driftline/stream-{uuid.uuid4().hex[:12]}"


def _derive(b):
    return b.selectExpr(
        "user_id as pk", "event_type as ck", "unix_micros(cast(ts as timestamp)) as wt", "event_id as seq", "case when event_id % 7 <> 0 then value end as val", "event_id % 7 = 0 as del",
        "case when event_id % 3 = 0 and event_id % 7 <> 0 then unix_seconds(cast(ts as timestamp)) + 86400 * (1 + event_id % 10) end as expiry")


class Feed:
    """A folder that grows by parts of ``events``, and a log of its mutations."""

    def __init__(self, s, d) -> None:
        self.s, self.events, self.root = s, X.table(s, d, "events"), _folder(s)
        self.log = R.MutationLog(s, f"{self.root}/log")

    def add(self, condition: str) -> None:
        self.events.where(condition).write.mode("append").parquet(f"{self.root}/in")

    def start(self, **kw):
        return R.replicate(R.tail(self.s, f"{self.root}/in", self.events.schema), self.log, f"{self.root}/checkpoint", _derive, **kw)

    def run(self, **kw) -> bool:
        """One run to the end; whether it was stopped by rows that cannot be written."""
        try:
            self.start(**kw).awaitTermination()
            return False
        except StreamingQueryException as e:
            if R.REJECTED not in str(e):
                raise
            return True


def _replicated(s, d, split_by: str | None = None):
    """A snapshot run, then a tail run over what was added since."""
    feed = Feed(s, d)
    for part in (0, 1):
        feed.add(f"event_id % 2 = {part}")
        feed.run(split_by=split_by)
    return feed.log


WINNERS = WON + " SELECT pk, ck, val, wt FROM w WHERE k = 1"


@query("snapshot_then_tail", WINNERS)
def _(s, d):
    return _replicated(s, d).state(["pk", "ck"], ["seq"]).select("pk", "ck", "val", "wt")


@query("checkpoint_resume", WON + " SELECT count(*) AS mutations, count(DISTINCT seq) AS distinct_mutations, TRUE AS stopped, sum(CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS before, 1 AS position_before, 2 AS position FROM cells")
def _(s, d):
    feed = Feed(s, d)
    feed.add("event_id % 2 = 0")
    feed.run()
    feed.add("event_id % 2 = 1")
    stopped = feed.run(reject="event_type = 'error'")  # the second batch fails
    before, position = feed.log.read().count(), R.position(s, f"{feed.root}/checkpoint")
    feed.run()  # and is taken whole when the cause is gone
    out = feed.log.read().agg(F.count("*").alias("mutations"), F.count_distinct("seq").alias("distinct_mutations"))
    return out.select("*", F.lit(stopped).alias("stopped"), F.lit(before).cast("long").alias("before"), F.lit(position).alias("position_before"), F.lit(R.position(s, f"{feed.root}/checkpoint")).alias("position"))


@query("stateful_lww", WINNERS)
def _(s, d):
    # the log is compacted between its runs, and late rows still lose to newer ones
    feed = Feed(s, d)
    for part in (2, 0, 1):
        feed.add(f"event_id % 3 = {part}")
        feed.run()
        feed.log.compact(["pk", "ck"], ["seq"])
    return feed.log.read().select("pk", "ck", "val", "wt")


@query("stream_envelopes", STATE + " SELECT * FROM st")
def _(s, d):
    """Envelopes as a stream: decoded, planned and taken apart in each batch,
    logged, compacted between two runs, and merged."""
    root, e = _folder(s), _with_row_deletes(s, d)
    log, keys = R.MutationLog(s, f"{root}/log"), ["pk", "ck"]

    def derive(b):
        return A.atoms(M.plan(D.decode(b, NOW), KINDS, CLASSES, NOW), keys, CLASSES, ["ck"], ["region"])

    for part in (0, 1):
        e.where(f"pk % 2 = {part}").write.mode("append").parquet(f"{root}/in")
        R.replicate(R.tail(s, f"{root}/in", e.schema), log, f"{root}/checkpoint", derive).awaitTermination()
        if not part:
            log.rewrite(lambda atoms: A.compact(atoms, ["source", *keys]))
    return A.state(log.read(), ["source", *keys]).drop("source")


@query("stream_keyed_state", STATE + ' SELECT pk, ck, "column", path, value, wt FROM st WHERE NOT del AND expiry IS NULL')
def _(s, d):
    """The same envelopes with their state kept in the stream.  Timers take
    what has expired by now, which all cells with an expiry have.  The second
    run restores the state and brings statics that are older."""
    root, e, keys = _folder(s), _with_row_deletes(s, d), ["pk", "ck"]
    for part in (1, 0):
        e.where(f"pmod(xxhash64(ck), 2) = {part}").write.mode("append").parquet(f"{root}/in")
        stream = R.tail(s, f"{root}/in", e.schema)
        atoms = A.atoms(M.plan(D.decode(stream, NOW), KINDS, CLASSES, NOW), keys, CLASSES, ["ck"], ["region"])
        Y.keep(Y.changes(atoms, keys), f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return Y.target(s, f"{root}/changes", keys).select(*keys, "column", "path", "value", "wt")


@query("collect_log", STATE + ' SELECT pk, ck, "column", path, value, wt FROM st WHERE NOT del AND expiry IS NULL')
def _(s, d):
    """The envelopes' atoms in three batches by time, each followed by a
    collection up to its end; then the first batch again, too late to revive
    anything.  What the log holds at the end is the live cells alone."""
    root, end, keys = _folder(s), NOW + 86_400, ["pk", "ck"]
    log = BucketedLog(s, f"{root}/log", keys, buckets=16)
    _atoms(s, d).write.parquet(f"{root}/atoms")
    atoms = s.read.parquet(f"{root}/atoms")
    cuts = atoms.agg(F.percentile_approx("wt", [0.3, 0.6]).alias("cuts")).first()["cuts"] or [0, 1]
    parts = [F.col("wt") <= cuts[0], F.col("wt").between(cuts[0] + 1, cuts[1]), F.col("wt") > cuts[1]]
    for batch, (part, horizon) in enumerate(zip([*parts, parts[0]], [*cuts, end * 1_000_000, None])):
        log.write(atoms.where(part), batch)
        log.collect(horizon, end)
    return log.read().select(*keys, "column", "path", "value", "wt")


@query("scan_tail", WON + " SELECT seq, wt FROM cells")
def _(s, d):
    return _replicated(s, d).read().select("seq", "wt")


@query("multi_table_stream", WON + " SELECT ck AS source, count(*) AS n FROM cells GROUP BY 1")
def _(s, d):
    return _replicated(s, d, split_by="ck").read().groupBy("source").agg(F.count("*").alias("n"))


@query("poison_policy", WON + " SELECT TRUE AS stopped, 0 AS written, 0 AS position, count(*) AS repaired, count(DISTINCT seq) AS rows FROM cells")
def _(s, d):
    feed = Feed(s, d)
    feed.add("true")
    stopped = feed.run(reject="event_type = 'error'")
    written = feed.log.read().count() if feed.log.exists() else 0
    position = R.position(s, f"{feed.root}/checkpoint")
    feed.run()
    out = feed.log.read().agg(F.count("*").alias("repaired"), F.count_distinct("seq").alias("rows"))
    return out.select("*", F.lit(stopped).alias("stopped"), F.lit(written).alias("written"), F.lit(position).alias("position"))


@query("stream_counters", "SELECT event_type AS ck, count(*) AS replayed, sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS last_batch, sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS errors FROM events GROUP BY 1")
def _(s, d):
    feed = Feed(s, d)
    for part in (0, 1):
        feed.add(f"event_id % 2 = {part}")
        feed.run(counters=R.Counters(f"{feed.root}/counters", ["ck"], "seq % 9 = 0"))
    return R.read_counters(s, f"{feed.root}/counters", ["ck"])


@query("range_growth", "SELECT user_id % 8 AS range_id, count(*) AS rows, (user_id % 8 >= 5)::INTEGER AS run FROM events GROUP BY ALL")
def _(s, d):
    root, events = _folder(s), X.table(s, d, "events").withColumn("range_id", F.col("user_id") % 8)
    log = R.MutationLog(s, f"{root}/log")
    schema = events.schema
    for run, part in enumerate(("range_id < 5", "range_id >= 5")):  # ranges that a restart finds
        events.where(part).write.mode("append").partitionBy("range_id").parquet(f"{root}/in")
        stream = R.tail(s, f"{root}/in", schema)
        R.replicate(stream, log, f"{root}/checkpoint", lambda b, run=run: b.select("range_id", F.lit(run).alias("run"))).awaitTermination()
    return log.read().groupBy("range_id", "run").agg(F.count("*").alias("rows"))


@query("cutover", "SELECT 'Completed' AS status, FALSE AS running, count(*) AS mutations FROM events UNION ALL SELECT 'Pending', TRUE, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT FROM events")
def _(s, d):
    out = None
    for ready in (True, False):
        feed = Feed(s, d)
        feed.add("event_id % 2 = 0")
        q = feed.start(forever_every="0 seconds")
        try:
            q.processAllAvailable()
            if ready:
                feed.add("event_id % 2 = 1")  # the cutover drains what has arrived
            status = R.cut_over(q, ready)
            running = q.isActive
        finally:
            q.stop()
        one = feed.log.read().agg(F.count("*").alias("mutations")).select(F.lit(status).alias("status"), F.lit(running).alias("running"), "mutations")
        out = one if out is None else out.union(one)
    return out


@query("sink_mutations", WON + " SELECT ck, count(*) AS n, max(wt) AS wt FROM cells GROUP BY 1")
def _(s, d):
    log = R.MutationLog(s, f"{_folder(s)}/log")
    for batch in (0, 1, 1):  # the second batch is written twice
        log.write(X.cells(s, d).where(F.col("seq") % 2 == batch), batch)
    return log.read().groupBy("ck").agg(F.count("*").alias("n"), F.max("wt").alias("wt"))


@query("sink_typed", "SELECT o_orderkey, o_custkey, 1 AS wt FROM orders")
def _(s, d):
    path = _folder(s)
    for _ in range(2):  # a batch that runs again writes its folder anew
        T.write_typed(X.table(s, d, "orders"), path, ["o_orderkey", "o_custkey"], 1, ["o_custkey"], {"o_orderkey": "desc"})
    return T.read_batches(s, path)


@query("drop_and_reload", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    path = _folder(s)
    n = X.table(s, d, "nation").select("n_nationkey", "n_name")
    n.limit(3).write.parquet(path)
    T.reload(n, path, started=False)
    return s.read.parquet(path)


@query("drop_and_reload_orders", "SELECT * FROM orders")
def _(s, d):
    path = _folder(s)
    o = X.table(s, d, "orders")
    o.limit(3).write.parquet(path)
    T.reload(o, path, started=False)
    return s.read.parquet(path)
