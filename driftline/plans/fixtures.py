"""Tables that Spark derives from the given ones, and the same as SQL.

``NOW`` is fixed, so results are reproducible.  Each ``*_SQL`` is a list of
common table expressions for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_706_659_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell mutations: pk, ck, wt, seq, val, del, expiry."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("pk"), F.col("event_type").alias("ck"), F.unix_micros(F.col("ts").cast("timestamp")).alias("wt"), F.col("event_id").alias("seq"),
        F.expr("case when event_id % 7 <> 0 then value end").alias("val"), F.expr("event_id % 7 = 0").alias("del"),
        F.expr("case when event_id % 3 = 0 and event_id % 7 <> 0 then unix_seconds(cast(ts as timestamp)) + 86400 * (1 + event_id % 10) end").alias("expiry"),
    )


CELLS = """cells AS (SELECT user_id AS pk, event_type AS ck, epoch_us(ts) AS wt, event_id AS seq,
  CASE WHEN event_id % 7 <> 0 THEN value END AS val, event_id % 7 = 0 AS del,
  CASE WHEN event_id % 3 = 0 AND event_id % 7 <> 0 THEN epoch_us(ts) // 1000000 + 86400 * (1 + event_id % 10) END AS expiry FROM events)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection mutations: pk, element, op, wt, seq."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("pk"), F.expr("concat(event_type, '_', event_id % 5)").alias("element"), F.unix_micros(F.col("ts").cast("timestamp")).alias("wt"), F.col("event_id").alias("seq"),
        F.expr("case when event_id % 50 = 0 then 'clear' when event_id % 4 = 0 then 'remove' else 'add' end").alias("op"),
    )


ELEMENTS = """el AS (SELECT user_id AS pk, event_type || '_' || (event_id % 5) AS element, epoch_us(ts) AS wt, event_id AS seq,
  CASE WHEN event_id % 50 = 0 THEN 'clear' WHEN event_id % 4 = 0 THEN 'remove' ELSE 'add' END AS op FROM events)"""


def counters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counters per part: origin and target (key, c1, c2)."""
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    origin = li.groupBy(F.col("l_partkey").alias("key")).agg(F.sum("q").alias("c1"), F.count("*").alias("c2"))
    origin = origin.withColumn("c1", F.expr("case when key % 11 <> 0 then c1 end"))
    target = li.where("(l_linenumber <= 4 or l_partkey % 7 = 0) and l_partkey % 5 <> 0").groupBy(F.col("l_partkey").alias("key")).agg(F.sum("q").alias("c1"), F.count("*").alias("c2"))
    return origin, target


COUNTERS = """o AS (SELECT l_partkey AS key, CASE WHEN l_partkey % 11 <> 0 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) END AS c1, count(*) AS c2 FROM lineitem GROUP BY l_partkey),
t AS (SELECT l_partkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS c1, count(*) AS c2 FROM lineitem WHERE (l_linenumber <= 4 OR l_partkey % 7 = 0) AND l_partkey % 5 <> 0 GROUP BY l_partkey)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page log: range_id, seq, done, t, props, value."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("range_id"), F.col("event_id").alias("seq"), F.expr("not (event_type = 'error' and event_id % 9 = 0 and user_id % 8 < 5)").alias("done"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "props", "event_type", "user_id",
    )


PAGES = """pages_ AS (SELECT user_id % 8 AS range_id, event_id AS seq, NOT (event_type = 'error' AND event_id % 9 = 0 AND user_id % 8 < 5) AS done,
  epoch_us(ts) // 1000000 AS t, props, event_type, user_id FROM events)"""


def copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, and a target that lacks, changes and adds some of them."""
    o = table(spark, sf_dir, "orders")
    t = o.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.expr("o_totalprice + case when o_orderkey % 89 = 0 then 1 else 0 end"))
    return o, t.union(o.where("o_orderkey % 101 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))


COPIES = """tgt AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operations log: conv_id, turn, message, level."""
    level = F.expr("case role when 'system' then 1 when 'assistant' then 3 else 4 end")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message"), level.alias("level"), "role")


LOG = "log AS (SELECT conv_id, turn, text AS message, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 3 ELSE 4 END AS level, role FROM conversations)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table units of jobs: one unit per customer, jobs by nation."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey as job", "concat('t', c_custkey) as tbl", "c_custkey", "c_custkey % 13 <> 0 or c_nationkey % 2 = 0 or c_nationkey % 12 = 1 as copy_complete",
        "case when c_custkey % 17 = 0 then 'NotFound' when c_custkey % 41 = 0 and c_nationkey % 3 = 0 then 'Failed' else 'OK' end as status",
        "c_nationkey % 2 = 1 as online", "c_custkey % 19 = 0 as skipped", "c_custkey % 5 = 0 as is_counter", "cast(c_custkey % 7 as bigint) * 10 as copied", "cast(60 as bigint) as total",
        "c_nationkey % 5 = 4 and c_custkey % 3 = 0 as faulted", "case c_nationkey % 6 when 1 then 'cutover' when 2 then 'stop' when 3 then 'pause' end as command",
        "case when c_nationkey % 4 = 0 then 'Paused' else 'Running' end as job_status", "c_acctbal", "cast(c_custkey % 11 as bigint) as replayed", "cast(c_custkey % 3 as bigint) as replay_errors", "cast(c_custkey % 2 as bigint) as failed",
        "timestamp_seconds(1700000000) as started", "timestamp_seconds(1700000000 + c_custkey * 7) as ended",
    )


UNITS = """units AS (SELECT c_nationkey AS job, 't' || c_custkey AS tbl, c_custkey, c_custkey % 13 <> 0 OR c_nationkey % 2 = 0 OR c_nationkey % 12 = 1 AS copy_complete,
  CASE WHEN c_custkey % 17 = 0 THEN 'NotFound' WHEN c_custkey % 41 = 0 AND c_nationkey % 3 = 0 THEN 'Failed' ELSE 'OK' END AS status,
  c_nationkey % 2 = 1 AS online, c_custkey % 19 = 0 AS skipped, c_custkey % 5 = 0 AS is_counter, (c_custkey % 7) * 10 AS copied, CAST(60 AS BIGINT) AS total,
  c_nationkey % 5 = 4 AND c_custkey % 3 = 0 AS faulted, CASE c_nationkey % 6 WHEN 1 THEN 'cutover' WHEN 2 THEN 'stop' WHEN 3 THEN 'pause' END AS command,
  CASE WHEN c_nationkey % 4 = 0 THEN 'Paused' ELSE 'Running' END AS job_status, c_acctbal, c_custkey % 11 AS replayed, c_custkey % 3 AS replay_errors, c_custkey % 2 AS failed FROM customer)"""
