"""Helpers that several operators share: scratch tables, ASCII text rules and
distributed connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Fixed by the query contracts: ASCII white space and the word pattern.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words once A-Z are lower-cased.
GAP_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, unless
    PYTHONPATH says where; a cluster may have it installed elsewhere."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a ``local`` master may go without that setting; it then gets a
    temporary folder, which is shared because there is one process.
    """
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes with the driver's JVM."""
    path = f"{scratch_root(spark)}/driftline/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder there, for files that tasks write themselves."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jpath)
    full = files.makeQualified(jpath).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: later stages, retries and lost executors read the
    files.  The files are removed when the driver's JVM ends, or by drop().
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that save() wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def packed(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` in as many tasks as ``rows`` need at ``per_task`` each (and one
    per core at least): small tables don't go through every shuffle partition
    in a task of its own."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, the base of all held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); a component is
    named by its smallest node.

    Alternates large-star and small-star steps, each a minimum per node and an
    equi-join of two written tables, so that Spark can split a hub's rows.
    Every edge ends up pointing at its component's smallest node.  Nulls and
    self-loops are ignored, except that a self-loop's node is kept.
    """
    spark = edges.sparkSession
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    loops = edges.where("src = dst").select("src", "dst")
    now = save(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), f"{name}-edges")
    loops = save(loops.distinct(), f"{name}-loops")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    was = state(now)
    while was[0]:  # each round halves the longest path or settles
        both = now.select("src", "dst").union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = save(both.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-min")
        # large star: every larger neighbour of u points at the least of u's neighbourhood
        large = save(now.join(low, F.col("dst") == F.col("u")).select("src", F.col("m").alias("dst")).where("src <> dst").distinct(), f"{name}-large")
        drop(low, now)
        low = save(large.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m")), f"{name}-min")
        # small star: u and its smaller neighbours point at the least of them
        small = large.join(low, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        now = save(small.union(low.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct(), f"{name}-edges")
        drop(low, large)
        is_now = state(now)
        if is_now == was:
            break
        was = is_now
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    alone = loops.select(F.col("src").alias("node")).join(nodes.select("node").union(roots.select("node")), "node", "left_anti")
    return nodes.union(roots).union(alone.select("node", F.col("node").alias("component")))
