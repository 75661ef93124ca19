"""Queries of cells, merges, counters, reconciliation, ranges and progress,
each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions import cells as C
from driftline.operators import catalog, counters, merge, progress, ranges, recon
from driftline.operators.scan import scan
from driftline.plans import fixtures as X
from driftline.sources import tables as T
from driftline.sources.scratch import shared_folder

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


WON = f"""WITH {X.CELLS}, w AS (SELECT *, row_number() OVER (PARTITION BY pk, ck ORDER BY wt DESC, del DESC, seq DESC) AS k FROM cells)"""


@query("lww_upsert", WON + f" SELECT pk, ck, val, wt, expiry FROM w WHERE k = 1 AND NOT del AND (expiry IS NULL OR expiry > {NOW})")
def _(s, d):
    return merge.visible(merge.newest(X.cells(s, d), ["pk", "ck"], tie=["seq"]), NOW).select("pk", "ck", "val", "wt", "expiry")


@query("replay_idempotent", WON + " SELECT pk, ck, val, wt, del FROM w WHERE k = 1")
def _(s, d):
    m = X.cells(s, d)
    return merge.newest(m.union(m), ["pk", "ck"], tie=["seq"]).select("pk", "ck", "val", "wt", "del")


@query("late_data", WON + " SELECT pk, ck, val, wt FROM w WHERE k = 1")
def _(s, d):
    m = X.cells(s, d)
    late, on_time = m.where("seq % 3 = 0"), m.where("seq % 3 <> 0")
    return merge.newest(on_time.union(late), ["pk", "ck"], tie=["seq"]).select("pk", "ck", "val", "wt")


@query("expired_filter", f"WITH {X.CELLS} SELECT pk, ck, seq FROM cells WHERE expiry <= {NOW}")
def _(s, d):
    return X.cells(s, d).where(C.is_expired(F.col("expiry"), NOW)).select("pk", "ck", "seq")


@query("latest_writetime", f"WITH {X.CELLS} SELECT pk, max(wt) AS latest FROM cells GROUP BY pk")
def _(s, d):
    by = X.cells(s, d).groupBy("pk").agg(F.max(F.when(F.col("ck") == "view", F.col("wt"))).alias("marker"), F.max(F.when(F.col("ck") != "view", F.col("wt"))).alias("cells"))
    return by.select("pk", C.latest_writetime(F.col("marker"), F.array("cells")).alias("latest"))


@query("longest_expiry", f"WITH {X.CELLS} SELECT pk, CASE WHEN count(*) = count(expiry) THEN max(expiry) END AS longest FROM cells WHERE ck <> 'view' OR expiry IS NOT NULL GROUP BY pk")
def _(s, d):
    by = X.cells(s, d).where("ck <> 'view' or expiry is not null").groupBy("pk").agg(C.longest_expiry_of(F.col("expiry")).alias("longest"))
    return by.select("pk", "longest")


@query("remaining_ttl", f"""WITH {X.CELLS} SELECT seq, CASE WHEN expiry IS NULL THEN 0 ELSE least(greatest(expiry + seq * 100000 - {NOW}, 1), 630720000) END AS ttl,
  coalesce(expiry + seq * 100000 - {NOW} > 630720000, FALSE) AS clamped,
  CASE WHEN expiry IS NULL THEN 0 ELSE least(greatest(expiry + seq * 100000 - {NOW}, 1), {min(C.MAX_TTL, C.LAST_SECOND - C.MARGIN - NOW)}) END AS ttl_2038 FROM cells""")
def _(s, d):
    e = F.col("expiry") + F.col("seq") * 100_000
    return X.cells(s, d).select("seq", C.remaining_ttl(e, NOW).alias("ttl"), C.ttl_clamped(e, NOW).alias("clamped"), C.remaining_ttl(e, NOW, True).alias("ttl_2038"))


@query("resolve_expiry", f"""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN epoch_us(ts) // 1000000 * (event_id % 2) + event_id % 3 > 0 THEN epoch_us(ts) // 1000000 * (event_id % 2) + event_id % 3
  ELSE {NOW} + event_id % 50 END AS expiry FROM events""")
def _(s, d):
    base = F.unix_seconds(F.col("ts").cast("timestamp")) * (F.col("event_id") % 2)
    return X.table(s, d, "events").select("event_id", C.resolve_expiry(F.col("event_id") % 50, F.col("event_id") % 3, base, NOW).alias("expiry"))


@query("ttl_expire_view", WON + f""", live AS (SELECT pk, ck FROM w WHERE k = 1 AND NOT del AND (expiry IS NULL OR expiry > {NOW})) SELECT DISTINCT pk FROM live""")
def _(s, d):
    state = merge.newest(X.cells(s, d), ["pk", "ck"], tie=["seq"])
    return merge.alive_rows(state.where("ck = 'view'"), state.where("ck <> 'view'"), ["pk"], NOW)


EL = f"""WITH {X.ELEMENTS}, c AS (SELECT pk, max(wt) AS cl FROM el WHERE op = 'clear' GROUP BY pk),
l AS (SELECT *, row_number() OVER (PARTITION BY pk, element ORDER BY wt DESC, (op = 'remove') DESC, seq DESC) AS k FROM el WHERE op <> 'clear'),
st AS (SELECT l.pk, element, wt FROM l LEFT JOIN c ON l.pk = c.pk WHERE k = 1 AND op = 'add' AND (cl IS NULL OR wt > cl))"""


@query("collection_add", EL + " SELECT pk, element, wt FROM st")
def _(s, d):
    return merge.collection_state(X.elements(s, d), ["pk"])


@query("collection_remove", f"""WITH {X.ELEMENTS}, l AS (SELECT *, row_number() OVER (PARTITION BY pk, element ORDER BY wt DESC, (op = 'remove') DESC, seq DESC) AS k FROM el WHERE op <> 'clear')
  SELECT pk, count(*) AS removed FROM l WHERE k = 1 AND op = 'remove' GROUP BY pk""")
def _(s, d):
    e = X.elements(s, d).where("op <> 'clear'")
    last = e.groupBy("pk", "element").agg(F.max_by("op", F.struct("wt", F.col("op") == "remove", "seq")).alias("op"))
    return last.where("op = 'remove'").groupBy("pk").agg(F.count("*").alias("removed"))


@query("range_tombstone", f"""WITH {X.ELEMENTS}, c AS (SELECT pk, max(wt) AS cl FROM el WHERE op = 'clear' GROUP BY pk)
  SELECT el.pk, count(*) AS hidden FROM el JOIN c ON el.pk = c.pk WHERE op <> 'clear' AND wt <= cl GROUP BY el.pk""")
def _(s, d):
    e = X.elements(s, d)
    c = e.where("op = 'clear'").groupBy("pk").agg(F.max("wt").alias("cl"))
    return e.where("op <> 'clear'").join(c, "pk").where("wt <= cl").groupBy("pk").agg(F.count("*").alias("hidden"))


@query("partial_upsert", WON + " SELECT pk, max(CASE WHEN ck = 'click' THEN val END) AS click, max(CASE WHEN ck = 'view' THEN val END) AS view FROM w WHERE k = 1 GROUP BY pk")
def _(s, d):
    state = merge.newest(X.cells(s, d), ["pk", "ck"], tie=["seq"]).withColumnRenamed("ck", "column")
    return merge.wide(state, ["pk"], ["click", "view"])


@query("column_update", WON + " SELECT pk, max(wt) AS wt, count(*) AS columns FROM w WHERE k = 1 AND ck <> 'view' GROUP BY pk")
def _(s, d):
    updates = X.cells(s, d).where("ck <> 'view'")  # no marker row is written
    return merge.newest(updates, ["pk", "ck"], tie=["seq"]).groupBy("pk").agg(F.max("wt").alias("wt"), F.count("*").alias("columns"))


@query("null_upsert", """SELECT event_id, c AS "column", v AS val, v IS NULL AS del FROM (SELECT event_id, unnest(['value', 'type']) AS c, unnest([CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END, event_type]) AS v FROM events)""")
def _(s, d):
    rows = X.table(s, d, "events").selectExpr("event_id", "case when event_id % 7 <> 0 then cast(user_id as string) end as value", "event_type as type", "unix_micros(cast(ts as timestamp)) as wt")
    return merge.deletes_for_nulls(rows, ["event_id"], ["value", "type"], F.col("wt")).select("event_id", "column", "val", "del")


@query("field_update", f"""SELECT user_id AS pk, event_type AS field, arg_max(event_id, (epoch_us(ts), event_id)) AS value FROM events GROUP BY ALL""")
def _(s, d):
    m = X.table(s, d, "events").selectExpr("user_id as pk", "event_type as field", "event_id as value", "unix_micros(cast(ts as timestamp)) as wt", "false as del", "cast(null as bigint) as expiry")
    return merge.newest(m, ["pk", "field"], "value").select("pk", "field", "value")


@query("batch_outcome", f"""WITH {X.PAGES}, r AS (SELECT range_id, user_id, max(CASE WHEN done THEN 0 ELSE 1 + seq % 2 END) AS worst FROM pages_ GROUP BY ALL)
  SELECT range_id, count(*) AS rows, sum(CASE WHEN worst = 0 THEN 1 ELSE 0 END)::BIGINT AS done, sum(CASE WHEN worst > 0 THEN 1 ELSE 0 END)::BIGINT AS failed, max(worst) = 0 AS complete FROM r GROUP BY range_id""")
def _(s, d):
    st = X.pages(s, d).withColumn("rank", F.expr("case when done then 0 else 1 + seq % 2 end"))
    return merge.outcomes(st, ["user_id"], ["range_id"])


CNT = f"WITH {X.COUNTERS}"
DELTA = CNT + """, j AS (SELECT o.key, CASE WHEN o.c1 IS NULL OR (t.c1 IS NOT NULL AND o.c1 = t.c1) THEN NULL ELSE o.c1 - coalesce(t.c1, 0) END AS d_c1,
  CASE WHEN t.c2 IS NOT NULL AND o.c2 = t.c2 THEN NULL ELSE o.c2 - coalesce(t.c2, 0) END AS d_c2 FROM o LEFT JOIN t ON o.key = t.key),
 dl AS (SELECT * FROM j WHERE d_c1 IS NOT NULL OR d_c2 IS NOT NULL)"""


@query("counter_delta", DELTA + " SELECT * FROM dl")
def _(s, d):
    return counters.counter_delta(*X.counters(s, d), ["key"], ["c1", "c2"])


@query("counter_apply", DELTA + """ SELECT coalesce(t.key, dl.key) AS key, CASE WHEN c1 IS NULL AND d_c1 IS NULL THEN NULL ELSE coalesce(c1, 0) + coalesce(d_c1, 0) END AS c1,
  CASE WHEN c2 IS NULL AND d_c2 IS NULL THEN NULL ELSE coalesce(c2, 0) + coalesce(d_c2, 0) END AS c2 FROM t FULL JOIN dl ON t.key = dl.key""")
def _(s, d):
    o, t = X.counters(s, d)
    return counters.counter_apply(t, counters.counter_delta(o, t, ["key"], ["c1", "c2"]), ["key"], ["c1", "c2"])


@query("join_counter_target", CNT + " SELECT o.key, o.c1, o.c2, t.c1 AS t_c1, t.c2 AS t_c2, t.key IS NOT NULL AS found FROM o LEFT JOIN t ON o.key = t.key")
def _(s, d):
    return counters.join_target(*X.counters(s, d), ["key"], ["c1", "c2"])


@query("counter_table_predicate", """SELECT l_suppkey % 50 AS tbl, bool_or(lower(CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN 'Counter' ELSE 'text' END) = 'counter') AS is_counter FROM lineitem GROUP BY 1""")
def _(s, d):
    return counters.counter_tables(X.table(s, d, "lineitem").selectExpr("l_suppkey % 50 as tbl", "case when l_linenumber = 7 and l_suppkey % 3 = 0 then 'Counter' else 'text' end as type"))


@query("recon_counts", f"WITH {X.COPIES} SELECT 'orders' AS tbl, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM tgt) AS target_rows, (SELECT count(*) FROM orders) = (SELECT count(*) FROM tgt) AS matches")
def _(s, d):
    return recon.recon_counts({"orders": X.copies(s, d)})


RECON = f"WITH {X.COPIES}"


@query("recon_rows", RECON + """ SELECT coalesce(o.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra'
  WHEN o.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AND o.o_custkey IS NOT DISTINCT FROM t.o_custkey AND o.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus THEN 'equal' ELSE 'different' END AS state
  FROM orders o FULL JOIN tgt t ON o.o_orderkey = t.o_orderkey""")
def _(s, d):
    return recon.recon_rows(*X.copies(s, d), ["o_orderkey"], ["o_totalprice", "o_custkey", "o_orderstatus"])


@query("pk_spot_check", RECON + " SELECT o.o_orderkey, o.o_totalprice = t.o_totalprice AS same FROM orders o JOIN tgt t ON o.o_orderkey = t.o_orderkey WHERE o.o_orderkey % 10 = 3")
def _(s, d):
    return recon.spot_check(*X.copies(s, d), ["o_orderkey"], F.col("o_orderkey") % 10 == 3, ["o_totalprice"])


@query("recon_ttl", WON + """, b AS (SELECT pk, ck, expiry AS ours, expiry + seq % 3 * 2 AS theirs FROM w WHERE k = 1)
  SELECT pk, ck, ours, theirs, CASE WHEN ours IS NULL THEN TRUE ELSE abs(ours - theirs) <= 2 END AS ttl_ok FROM b""")
def _(s, d):
    st = merge.newest(X.cells(s, d).withColumn("s", F.struct("seq", "val")), ["pk", "ck"], "s", tie=["seq"])
    return recon.recon_ttl(st, st.withColumn("expiry", F.col("expiry") + F.col("s.seq") % 3 * 2), ["pk", "ck"], 2)


@query("recon_collections", """SELECT a.pk, a.l <> b.l AS differs FROM (SELECT user_id AS pk, list_sort(list(DISTINCT event_type)) AS l FROM events GROUP BY 1) a
  JOIN (SELECT user_id AS pk, list_sort(list(DISTINCT event_type)) AS l FROM events WHERE event_id % 5 <> 0 GROUP BY 1) b ON a.pk = b.pk""")
def _(s, d):
    e = X.table(s, d, "events").withColumnRenamed("user_id", "pk")
    sets = lambda x: x.groupBy("pk").agg(F.collect_set("event_type").alias("l"))
    return recon.recon_collections(sets(e), sets(e.where("event_id % 5 <> 0")), ["pk"], "l")


@query("recon_elements", """WITH a AS (SELECT user_id AS pk, list(DISTINCT event_type) AS l FROM events WHERE event_id % 3 <> 1 GROUP BY 1), b AS (SELECT user_id AS pk, list(DISTINCT event_type) AS l FROM events WHERE event_id % 5 <> 0 AND user_id % 7 <> 3 GROUP BY 1),
  x AS (SELECT coalesce(a.pk, b.pk) AS pk, CASE WHEN b.pk IS NULL THEN 'source' WHEN a.pk IS NULL THEN 'target' ELSE 'both' END AS side, list_sort(list_filter(coalesce(a.l, []), lambda v: NOT list_contains(coalesce(b.l, []), v))) AS only_source,
    list_sort(list_filter(coalesce(b.l, []), lambda v: NOT list_contains(coalesce(a.l, []), v))) AS only_target FROM a FULL JOIN b ON a.pk = b.pk)
  SELECT * FROM x WHERE side <> 'both' OR len(only_source) > 0 OR len(only_target) > 0""")
def _(s, d):
    e = X.table(s, d, "events").withColumnRenamed("user_id", "pk")
    sets = lambda x: x.groupBy("pk").agg(F.collect_set("event_type").alias("l"))
    return recon.recon_elements(sets(e.where("event_id % 3 <> 1")), sets(e.where("event_id % 5 <> 0 and pk % 7 <> 3")), ["pk"], "l")


@query("recon_tree", RECON + """ SELECT coalesce(o.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra' ELSE 'different' END AS state
  FROM orders o FULL JOIN tgt t ON o.o_orderkey = t.o_orderkey WHERE t.o_orderkey IS NULL OR o.o_orderkey IS NULL OR o.o_totalprice IS DISTINCT FROM t.o_totalprice""")
def _(s, d):
    return recon.recon_tree(*X.copies(s, d), ["o_orderkey"], ["o_totalprice", "o_custkey", "o_orderstatus"])


@query("recon_static", """WITH a AS (SELECT user_id AS pk, max(event_id) AS v FROM events GROUP BY 1), b AS (SELECT user_id AS pk, max(event_id) AS v FROM events WHERE event_id % 4 <> 0 GROUP BY 1)
  SELECT coalesce(a.pk, b.pk) AS pk, a.v AS ours, b.v AS theirs FROM a FULL JOIN b ON a.pk = b.pk WHERE a.v IS DISTINCT FROM b.v""")
def _(s, d):
    e = X.table(s, d, "events").withColumnRenamed("user_id", "pk")
    m = lambda x: x.groupBy("pk").agg(F.max("event_id").alias("v"))
    return recon.recon_static(m(e), m(e.where("event_id % 4 <> 0")), ["pk"], "v")


PG = f"WITH {X.PAGES}"


@query("safe_resume_point", PG + " SELECT range_id, coalesce(min(CASE WHEN NOT done THEN seq END), max(seq) + 1) AS next_seq FROM pages_ GROUP BY range_id")
def _(s, d):
    return ranges.safe_resume_point(X.pages(s, d), ["range_id"])


@query("trim_completed_prefix", PG + ", f AS (SELECT range_id, min(seq) AS m FROM pages_ WHERE NOT done GROUP BY 1) SELECT p.range_id, seq, done FROM pages_ p JOIN f ON p.range_id = f.range_id WHERE seq >= m")
def _(s, d):
    return ranges.untrimmed(X.pages(s, d), ["range_id"]).select("range_id", "seq", "done")


@query("range_progress", PG + ", r AS (SELECT user_id % 5 AS tbl, range_id, bool_and(done) AS d FROM pages_ GROUP BY ALL) SELECT tbl, sum(CASE WHEN d THEN 1 ELSE 0 END)::BIGINT AS complete, count(*) AS ranges, bool_and(d) AS drained FROM r GROUP BY tbl")
def _(s, d):
    return ranges.range_progress(X.pages(s, d).withColumn("tbl", F.col("user_id") % 5), ["tbl"])


@query("scan_ranges", "SELECT DISTINCT user_id % 8 AS range_id FROM events")
def _(s, d):
    return ranges.required_ranges(X.pages(s, d))


@query("scan_range", PG + " SELECT range_id, seq FROM pages_ WHERE range_id = 3")
def _(s, d):
    path = f"{shared_folder(s)}/driftline/ranges-{uuid.uuid4().hex[:12]}"
    X.pages(s, d).write.partitionBy("range_id").parquet(path)
    return ranges.scan_range(s, path, 3).select("range_id", "seq")


@query("scan_page", PG + ", o AS (SELECT seq % 50 AS part, seq, t, row_number() OVER (ORDER BY seq % 50, seq) AS k FROM pages_) SELECT CAST((k - 1) // 300 AS INTEGER) AS page, part, seq, t FROM o WHERE k <= 600")
def _(s, d):
    # two pages; the second goes on where the first says, amid rows of one part
    rows = X.pages(s, d).withColumn("part", F.col("seq") % 50)
    first = ranges.page(rows, {"part": None, "seq": None}, 300)
    last = first.agg(F.max("next").alias("next")).first()["next"]
    second = ranges.page(rows, last.asDict(), 300)
    return first.withColumn("page", F.lit(0)).union(second.withColumn("page", F.lit(1))).select("page", "part", "seq", "t")


@query("page_index", "SELECT page, count(*) AS rows, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 500 AS page FROM lineitem) GROUP BY page")
def _(s, d):
    pages = ranges.paged(X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 500)
    return pages.groupBy("page").agg(F.count("*").alias("rows"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))


@query("balanced_ranges", """WITH r AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_orderkey END AS k, l_orderkey, l_linenumber FROM lineitem), o AS (SELECT k, l_orderkey, l_linenumber, (row_number() OVER (ORDER BY k, l_orderkey, l_linenumber) - 1) // 1000 AS range FROM r)
SELECT range, min(k) AS first_key, max(k) AS last_key, count(*) AS rows FROM o GROUP BY range""")
def _(s, d):
    # one key holds half of all rows
    rows = X.table(s, d, "lineitem").selectExpr("if(l_orderkey % 2 = 0, 0L, l_orderkey) as k", "l_orderkey", "l_linenumber")
    return ranges.balanced(rows, ["k", "l_orderkey", "l_linenumber"], 1000).select("range", F.col("first.k").alias("first_key"), F.col("last.k").alias("last_key"), "rows")


@query("prefix_scan", """SELECT event_id, CAST(sum(user_id) OVER w AS BIGINT) AS running, last_value(CASE WHEN event_id % 5 = 0 THEN user_id END IGNORE NULLS) OVER w AS last_fifth, lag(user_id) OVER w AS user_before,
  first_value(user_id) OVER w AS first_user FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    rows, user = X.table(s, d, "events"), F.col("user_id")
    out = scan(rows, ["event_type"], "event_id", sums={"running": user}, lasts={"last_fifth": F.when(F.col("event_id") % 5 == 0, user)}, lags={"user_before": user}, firsts={"first_user": user}, span=1_000)
    return out.select("event_id", "running", "last_fifth", "user_before", "first_user")


RG = """WITH st AS (SELECT DISTINCT user_id AS range_id, user_id % 3 = 0 AS done FROM events WHERE user_id % 4 <> 0), sr AS (SELECT DISTINCT user_id AS range_id FROM events WHERE user_id % 7 <> 0),
 al AS (SELECT * FROM st UNION ALL SELECT range_id, FALSE FROM sr WHERE range_id NOT IN (SELECT range_id FROM st))"""


def _stored(s, d):
    e = X.table(s, d, "events").select(F.col("user_id").alias("range_id"))
    return e.where("range_id % 4 <> 0").distinct().withColumn("done", F.col("range_id") % 3 == 0), e.where("range_id % 7 <> 0")


@query("union_ranges", RG + " SELECT * FROM al")
def _(s, d):
    return ranges.union_ranges(*_stored(s, d))


@query("anti_new_ranges", RG + " SELECT range_id FROM sr WHERE range_id NOT IN (SELECT range_id FROM st)")
def _(s, d):
    return ranges.new_ranges(*_stored(s, d))


@query("pending_ranges", RG + " SELECT range_id, 'Bulk' AS phase, FALSE AS online FROM al WHERE NOT done UNION ALL SELECT range_id, CASE WHEN done THEN 'Replay' ELSE 'Bulk' END, TRUE FROM al")
def _(s, d):
    al = ranges.union_ranges(*_stored(s, d))
    return ranges.pending_ranges(al, False).withColumn("online", F.lit(False)).union(ranges.pending_ranges(al, True).withColumn("online", F.lit(True)))


@query("known_ranges", RG + " SELECT count(*) AS ranges, sum(CASE WHEN done THEN 1 ELSE 0 END)::BIGINT AS done FROM al")
def _(s, d):
    return ranges.union_ranges(*_stored(s, d)).agg(F.count("*").alias("ranges"), F.count_if("done").alias("done"))


@query("page_stats", PG + """ SELECT range_id, sum(CASE WHEN done THEN 1 ELSE 0 END)::BIGINT AS rows_done, sum(CASE WHEN done THEN 0 ELSE 1 END)::BIGINT AS rows_failed, sum(seq % 1000)::BIGINT AS latency_ms,
  sum(length(props) * 2 + 8 + CASE WHEN seq % 4 = 0 THEN 0 ELSE octet_length(encode(event_type)) END)::BIGINT AS bytes FROM pages_ GROUP BY 1""")
def _(s, d):
    p = X.pages(s, d).withColumn("ms", F.col("seq") % 1000).withColumn("blob", F.when(F.col("seq") % 4 != 0, F.col("event_type").cast("binary")))
    return progress.page_stats(p, ["range_id"], ["props", "seq", "blob"], "ms")


LAT = PG + """, g AS (SELECT range_id, sum(length(props) * (1 + range_id % 3) * 20)::BIGINT // count(*) AS read_ms, sum(seq % 1000)::BIGINT // count(*) AS write_ms,
  sum(CASE WHEN seq % 3 = 0 THEN seq % 1000 END) / nullif(sum(CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END), 0) AS item_ms FROM pages_ GROUP BY 1)"""


def _lat(s, d):
    p = X.pages(s, d).withColumn("r", F.expr("length(props) * (1 + range_id % 3) * 20")).withColumn("w", F.col("seq") % 1000)
    return progress.average_latency(p, ["range_id"], "r", "w", F.col("seq") % 3 == 0)


@query("avg_latency", LAT + " SELECT * FROM g")
def _(s, d):
    return _lat(s, d)


@query("bottleneck_class", LAT + " SELECT range_id, CASE WHEN read_ms > 2 * write_ms THEN 'READ-BOUND' WHEN write_ms > 2 * read_ms THEN 'WRITE-BOUND' ELSE 'BALANCED' END AS class FROM g")
def _(s, d):
    return _lat(s, d).select("range_id", progress.bottleneck(F.col("read_ms"), F.col("write_ms")).alias("class"))


@query("max_lag", PG + f" SELECT max({NOW} - last) AS lag, max({NOW} - last) < 30 AS low FROM (SELECT range_id, max(t) AS last FROM pages_ GROUP BY 1)")
def _(s, d):
    return progress.max_lag(X.pages(s, d).groupBy("range_id").agg(F.max("t").alias("last")), NOW)


@query("event_lag", f"""WITH e AS (SELECT user_id % 50 AS range_id, event_type AS tbl, epoch_us(ts) AS wt, CASE WHEN event_id % 11 <> 0 THEN event_id % 5 <> 0 AND event_type <> 'error' END AS done, epoch_us(ts) // 1000000 + event_id % 60 AS polled FROM events),
  g AS (SELECT range_id, tbl, max(polled) AS p, max(wt) AS seen, max(CASE WHEN done THEN wt END) AS w FROM e GROUP BY ALL)
  SELECT range_id, tbl, {NOW} - p AS poll_age, ({NOW} * 1000000::BIGINT - w) // 1000000 AS lag, (seen - w) // 1000000 AS behind FROM g""")
def _(s, d):
    e = X.table(s, d, "events").select(
        F.expr("user_id % 50").alias("range_id"), F.col("event_type").alias("tbl"), F.expr("unix_micros(cast(ts as timestamp))").alias("wt"),
        F.expr("case when event_id % 11 <> 0 then event_id % 5 <> 0 and event_type <> 'error' end").alias("done"), F.expr("unix_seconds(cast(ts as timestamp)) + event_id % 60").alias("polled"),
    )
    return progress.event_lag(e, ["range_id", "tbl"], NOW)


@query("progress_percent", PG + ", t AS (SELECT range_id, sum(CASE WHEN done THEN 1 ELSE 0 END) AS w, CASE WHEN range_id % 4 = 1 THEN 0 WHEN range_id % 4 = 2 THEN count(*) // 2 ELSE count(*) END AS n FROM pages_ GROUP BY 1) SELECT range_id, CASE WHEN n > 0 THEN least(99.9, w / n * 100) END AS percent, n > 0 AND w > n AS stale FROM t")
def _(s, d):
    by = X.pages(s, d).groupBy("range_id").agg(F.count_if("done").alias("w"), F.expr("case when range_id % 4 = 1 then 0 when range_id % 4 = 2 then count(*) div 2 else count(*) end").alias("n"))
    return by.select("range_id", progress.progress_percent(F.col("w"), F.col("n")).alias("percent"), progress.stale_total(F.col("w"), F.col("n")).alias("stale"))


SAMP = PG + ", s AS (SELECT range_id, t // 3600 AS t, count(*) AS n FROM pages_ GROUP BY ALL), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY range_id ORDER BY t) AS BIGINT) AS copied, min(t) OVER (PARTITION BY range_id) - 1 AS started FROM s)"


def _samples(s, d):
    from pyspark.sql import Window

    by = X.pages(s, d).groupBy("range_id", F.expr("t div 3600").alias("t")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("range_id")
    return by.withColumn("copied", F.sum("n").over(w.orderBy("t"))).withColumn("started", F.min("t").over(w) - 1)


@query("recent_speed", SAMP + " SELECT range_id, t, coalesce((copied - lag(copied) OVER w) / (t - lag(t) OVER w), copied / (t - started)) AS speed FROM c WINDOW w AS (PARTITION BY range_id ORDER BY t)")
def _(s, d):
    return progress.recent_speed(_samples(s, d), "range_id").select("range_id", "t", "speed")


@query("speed_sum", SAMP + ", v AS (SELECT coalesce((copied - lag(copied) OVER w) // (t - lag(t) OVER w), 0) - 1 AS v FROM c WINDOW w AS (PARTITION BY range_id ORDER BY t)) SELECT coalesce(sum(CASE WHEN v > 0 THEN v END), 0)::BIGINT AS speed FROM v")
def _(s, d):
    return progress.speed_sum(_samples(s, d), "range_id", least=1)


@query("sticky_last_batch", SAMP + " SELECT range_id, t, last_value(nullif(n % 3, 0) IGNORE NULLS) OVER (PARTITION BY range_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sticky FROM c")
def _(s, d):
    return progress.sticky_last(_samples(s, d).withColumn("b", F.col("n") % 3), "range_id", "t", "b").select("range_id", "t", "sticky")


@query("session_delta", SAMP + " SELECT range_id, t, copied - first_value(copied) OVER (PARTITION BY range_id, t // 24 ORDER BY t) AS delta FROM c")
def _(s, d):
    return progress.session_delta(_samples(s, d).withColumn("day", F.expr("t div 24")), ["range_id", "day"], "t").select("range_id", "t", "delta")


@query("consecutive_failures", PG + """, m AS (SELECT range_id, done, sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY range_id ORDER BY seq) AS run FROM pages_ WHERE event_type IN ('error', 'click')),
  r AS (SELECT range_id, run, count(*) AS n FROM m WHERE NOT done GROUP BY ALL) SELECT k.range_id, coalesce(max(n), 0) AS longest, coalesce(max(n), 0) >= 3 AS gives_up FROM (SELECT DISTINCT range_id FROM m) k LEFT JOIN r ON k.range_id = r.range_id GROUP BY 1""")
def _(s, d):
    return ranges.failure_runs(X.pages(s, d).where("event_type in ('error', 'click')").withColumn("failed", ~F.col("done")), ["range_id"], "seq", "failed", 3)


LG = f"WITH {X.LOG}"


@query("log_head_tail", LG + " SELECT conv_id, turn, message FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS a, row_number() OVER (ORDER BY conv_id DESC, turn DESC) AS b FROM log) WHERE a <= 20 OR b <= 280")
def _(s, d):
    return ranges.head_and_tail(X.log(s, d), ["conv_id", "turn"], 20, 280).select("conv_id", "turn", "message")


@query("log_level_filter", LG + " SELECT conv_id, turn, level FROM log WHERE level <= 3")
def _(s, d):
    return progress.log_at_level(X.log(s, d), 3).select("conv_id", "turn", "level")


@query("log_search", LG + " SELECT conv_id, turn FROM log WHERE lower(message) LIKE '%the a%' AND role <> 'system'")
def _(s, d):
    return progress.log_search(X.log(s, d).where("role <> 'system'"), "The A").select("conv_id", "turn")


@query("page_logs", LG + " SELECT conv_id, turn, level FROM log ORDER BY conv_id, turn LIMIT 100 OFFSET 50")
def _(s, d):
    return ranges.log_page(X.log(s, d), ["conv_id", "turn"], 50, 100).select("conv_id", "turn", "level")


UN = f"WITH {X.UNITS}"


@query("valid_unit_filter", UN + " SELECT tbl FROM units WHERE status IN ('OK', 'Failed')")
def _(s, d):
    return progress.valid_units(X.units(s, d)).select("tbl")


@query("remaining_work_filter", UN + " SELECT tbl FROM units WHERE status IN ('OK', 'Failed') AND NOT (copy_complete AND NOT online) AND NOT skipped")
def _(s, d):
    return progress.remaining_work(X.units(s, d)).select("tbl")


@query("job_totals", UN + """ SELECT job, sum(CASE WHEN is_counter AND online THEN 0 ELSE copied END)::BIGINT AS copied, sum(CASE WHEN is_counter AND online THEN 0 ELSE total END)::BIGINT AS total,
  count_if(copy_complete)::BIGINT AS complete, count_if(NOT copy_complete AND copied > 0)::BIGINT AS in_progress, count_if(status = 'Failed')::BIGINT AS failed, count_if(is_counter)::BIGINT AS counters, sum(CASE WHEN online THEN replayed ELSE 0 END)::BIGINT AS replayed FROM units GROUP BY job""")
def _(s, d):
    return progress.job_totals(X.units(s, d))


@query("processed_totals", UN + " SELECT job, sum(copied)::BIGINT AS inserted, sum(CASE WHEN status = 'Failed' THEN total - copied ELSE 0 END)::BIGINT AS failed FROM units GROUP BY job")
def _(s, d):
    return progress.processed_totals(X.units(s, d))


@query("total_rows", UN + " SELECT tbl, greatest(copied, total) AS total_rows FROM units")
def _(s, d):
    return progress.total_rows(X.units(s, d)).select("tbl", "total_rows")


@query("cutover_ready", UN + " SELECT job, bool_and(copy_complete OR status = 'NotFound') AS ready FROM units GROUP BY job")
def _(s, d):
    return progress.cutover_ready(X.units(s, d))


@query("cutover_jobs", UN + " SELECT job, 'Completed' AS status FROM units GROUP BY job HAVING bool_and(copy_complete OR status = 'NotFound') AND max(command) = 'cutover'")
def _(s, d):
    u = X.units(s, d)
    asked = u.groupBy("job").agg(F.max("command").alias("command")).where("command = 'cutover'")
    return progress.cutover_ready(u).where("ready").join(asked, "job").select("job", F.lit("Completed").alias("status"))


@query("offline_complete", UN + " SELECT job, bool_and(status = 'NotFound' OR copy_complete) AS complete FROM units WHERE NOT online GROUP BY job")
def _(s, d):
    return progress.offline_complete(X.units(s, d))


@query("final_status", UN + """ SELECT job, CASE WHEN bool_or(faulted) OR bool_or(status = 'Failed') THEN 'Faulted' WHEN max(command) = 'cutover' THEN 'Completed' WHEN max(command) = 'stop' THEN 'Cancelled'
  WHEN max(command) = 'pause' THEN 'Paused' WHEN bool_and(NOT online AND (copy_complete OR status = 'NotFound')) THEN 'Completed' ELSE 'Pending' END AS final_status FROM units GROUP BY job""")
def _(s, d):
    return progress.final_status(X.units(s, d))


@query("table_state", UN + """ SELECT tbl, CASE WHEN status = 'NotFound' THEN 'missing' WHEN status = 'Failed' THEN 'failed' WHEN skipped THEN 'skipped' WHEN copy_complete AND online AND job_status = 'Paused' THEN 'replay paused'
  WHEN copy_complete AND online AND job_status = 'Running' THEN 'replaying' WHEN copy_complete THEN 'complete' WHEN job_status = 'Paused' AND copied > 0 THEN 'paused' WHEN copied > 0 THEN 'copying' ELSE 'pending' END AS state FROM units""")
def _(s, d):
    return progress.table_state(X.units(s, d)).select("tbl", "state")


@query("semi_job_units", UN + ", j AS (SELECT n_nationkey AS job FROM nation WHERE n_regionkey < 3) SELECT tbl, job IN (SELECT job FROM j) AS kept FROM units")
def _(s, d):
    u, j = X.units(s, d), X.table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("job"))
    return progress.units_of_jobs(u, j).select("tbl", "kept")


@query("eta_seconds", UN + " SELECT tbl, CASE WHEN total - copied > 0 AND copied > 0 THEN (total - copied) / CAST(copied AS DOUBLE) END AS eta FROM units")
def _(s, d):
    return X.units(s, d).select("tbl", C.eta_seconds(F.col("total") - F.col("copied"), F.col("copied").cast("double")).alias("eta"))


@query("duration_seconds", "SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000000 AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    both = X.table(s, d, "lineitem").join(X.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", C.duration_seconds(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))


@query("poll_age_seconds", f"SELECT event_id, CASE WHEN {NOW - 86400 * 5} - epoch_us(ts) // 1000000 >= 0 THEN {NOW - 86400 * 5} - epoch_us(ts) // 1000000 END AS age FROM events")
def _(s, d):
    return X.table(s, d, "events").select("event_id", C.poll_age_seconds(F.col("ts"), NOW - 86400 * 5).alias("age"))


@query("unit_id", "SELECT c_custkey, substr(sha256(c_mktsegment || '.' || c_name), 1, 16) AS unit_id FROM customer")
def _(s, d):
    return X.table(s, d, "customer").select("c_custkey", C.unit_id(F.col("c_mktsegment"), F.col("c_name")).alias("unit_id"))


@query("effective_target", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_size % 3 = 1 THEN p_name ELSE p_brand END AS target FROM part")
def _(s, d):
    over = F.expr("case when p_size % 3 = 0 then '  ' when p_size % 3 = 1 then null else p_brand end")
    return X.table(s, d, "part").select("p_partkey", C.effective_target(over, F.col("p_name")).alias("target"))


@query("normalize_type", "SELECT p_partkey, lower(replace('Map< ' || p_type || ', INT >', ' ', '')) AS type FROM part")
def _(s, d):
    return X.table(s, d, "part").select("p_partkey", C.normalize_type(F.concat(F.lit("Map< "), "p_type", F.lit(", INT >"))).alias("type"))


@query("nonfrozen_classify", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'list' WHEN 1 THEN 'set' WHEN 2 THEN 'map' WHEN 3 THEN 'frozen' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'udt' ELSE 'simple' END END AS class FROM part")
def _(s, d):
    t = F.expr("case p_size % 5 when 0 then 'List<int>' when 1 then 'set<text>' when 2 then 'MAP<text, int>' when 3 then 'frozen<list<int>>' else if(p_partkey % 2 = 0, 'address', 'text') end")
    return X.table(s, d, "part").select("p_partkey", C.column_class(t, t == "address").alias("class"))


@query("classify_errors", """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'auth' WHEN 1 THEN 'not_found' WHEN 2 THEN 'throttle' WHEN 3 THEN 'transient' WHEN 4 THEN 'fatal' WHEN 5 THEN 'throttle' WHEN 6 THEN 'fatal' WHEN 7 THEN 'throttle' ELSE 'other' END AS class FROM events""")
def _(s, d):
    kind = F.expr("case event_id % 9 when 0 then 'UnauthorizedException' when 1 then 'InvalidQueryException' when 3 then 'ReadTimeoutException' when 4 then 'SyntaxError' when 5 then 'OverloadedException' when 6 then 'InvalidQueryException' when 7 then 'WriteTimeoutException' else 'Exception' end")
    msg = F.expr("case event_id % 9 when 1 then 'Table Does Not Exist' when 2 then 'Request RATE is large' when 6 then 'code 429' when 7 then 'rate limit' else event_type end")
    return X.table(s, d, "events").select("event_id", C.classify_error(kind, msg).alias("class"))


@query("retry_hint_ms", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE least(30000, CAST(pow(2, least(1 + event_id % 14, 10) - 1) * 1000 AS BIGINT)) END AS ms FROM events")
def _(s, d):
    msg = F.expr("case when event_id % 3 = 0 then concat('busy, RetryAfterMs=', event_id, ' please') else 'busy' end")
    return X.table(s, d, "events").select("event_id", C.retry_delay_ms(msg, 1 + F.col("event_id") % 14).alias("ms"))


@query("scan_typed", "SELECT * FROM nation")
def _(s, d):
    return T.read_typed(s, f"{d}/nation.parquet", ["n_nationkey", "n_name", "n_regionkey"])


@query("scan_typed_orders", "SELECT * FROM orders")
def _(s, d):
    return T.read_typed(s, f"{d}/orders.parquet")


@query("row_count", "SELECT 'orders' AS tbl, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'lost', -1")
def _(s, d):
    named = lambda n, t: T.row_count(t).select(F.lit(n).alias("tbl"), "rows")
    return named("orders", X.table(s, d, "orders")).union(named("lineitem", X.table(s, d, "lineitem"))).union(named("lost", None))


@query("table_nonempty", "SELECT 'orders' AS tbl, count(*) > 0 AS nonempty FROM orders UNION ALL SELECT 'none', count(*) > 0 FROM orders WHERE o_orderkey < 0 UNION ALL SELECT 'lost', TRUE")
def _(s, d):
    reads = {"orders": lambda: X.table(s, d, "orders"), "none": lambda: X.table(s, d, "orders").where("o_orderkey < 0"), "lost": lambda: X.table(s, d, "no_such_table")}
    return s.createDataFrame([(n, T.has_data(read)) for n, read in reads.items()], "tbl string, nonempty boolean")


@query("project_by_name", """SELECT n_name AS "N_NAME", n_nationkey AS "N_NationKey" FROM nation""")
def _(s, d):
    return catalog.project_by_name(X.table(s, d, "nation"), ["N_NAME", "N_NationKey"])


@query("project_by_name_orders", """SELECT o_orderstatus AS "O_ORDERSTATUS", o_orderkey AS "O_OrderKey" FROM orders""")
def _(s, d):
    return catalog.project_by_name(X.table(s, d, "orders"), ["O_ORDERSTATUS", "O_OrderKey"])


@query("sink_dry_run", f"WITH {X.CELLS} SELECT ck, count(*) AS would_write FROM cells GROUP BY ck")
def _(s, d):
    return T.dry_run(X.cells(s, d), ["ck"])


@query("job_report", UN + """ SELECT n.n_name AS job_name, u.tbl, u.status, u.copied, u.failed, least(99.9, u.copied / u.total * 100) AS percent, u.copied > u.total AS stale, u.c_custkey * 7 AS seconds,
  CASE WHEN online THEN replayed END AS replayed, CASE WHEN online THEN replay_errors END AS replay_errors FROM units u JOIN nation n ON u.job = n.n_nationkey""")
def _(s, d):
    jobs = X.table(s, d, "nation").select(F.col("n_nationkey").alias("job"), F.col("n_name").alias("job_name"))
    return progress.job_report(jobs, X.units(s, d))
