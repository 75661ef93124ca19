"""Continuous replication: a snapshot and its tail are one streaming query.

Mutations are kept in a log whose content is stated by versions: a version is a
small file that names the folders in force, and replaces its predecessor as a
whole.  A batch writes a folder of its own and then a version that has it; a
batch that runs again replaces its folder in the next version, so that a
restart never adds a row twice.  The state of the target is the newest mutation
per source and key over the log (merge on read); compaction puts that state in
the place of the batches so far.  What a compaction replaces is deleted by the
next one, so a reader that began before it can finish.  Nothing is dropped for
being late: order does not matter, so no watermark is needed.  A batch that
cannot be written whole stops the query before the position moves, and is taken
again by the next run.  A batch is derived once: what it holds that cannot be
written is observed while it is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.operators import merge
from driftline.operators.progress import cutover_ready

#: What the failure of a rejected batch says.
REJECTED = "has rows that cannot be written"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbered(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Numbers of the files ``<prefix><number>`` under ``path``."""
    p, files = _files(spark, path)
    if not files.exists(p):
        return []
    names = [f.getPath().getName() for f in files.listStatus(p)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


class MutationLog:
    """Mutations in a folder: ``data`` has a folder per batch and compacted
    state, parted by source; ``versions`` says which of them are in force."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def manifest(self, version: int | None = None) -> dict:
        """A version's content; without a number the newest one's."""
        numbers = _numbered(self.spark, f"{self.path}/versions", "v") if version is None else [version]
        if not numbers:
            return {"version": 0, "upto": None, "base": None, "batches": {}, "schema": None, "retired": []}
        p, files = _files(self.spark, f"{self.path}/versions/v{numbers[-1]}")
        stream = files.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, change: Callable[[dict], dict]) -> dict:
        """Put the changed newest version in its place; again, if another
        writer was first."""
        while True:
            now = self.manifest()
            new = change(now) | {"version": now["version"] + 1}
            temp, files = _files(self.spark, f"{self.path}/versions/.new-{uuid.uuid4().hex}")
            final, _ = _files(self.spark, f"{self.path}/versions/v{new['version']}")
            out = files.create(temp, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            if not files.exists(final) and files.rename(temp, final):
                return new
            files.delete(temp, False)

    def stage(self, mutations: DataFrame, name: str, source=None) -> tuple[str, StructType]:
        """Write a folder that no version has yet; its name and schema.
        ``source``: the column that names each mutation's table; rows with a
        null there have a source of their own, which reads as null."""
        named = mutations.withColumn("source", F.lit("main") if source is None else F.col(source).cast("string"))
        folder = f"at={name}-{uuid.uuid4().hex[:8]}"
        named.write.partitionBy("source").parquet(f"{self.path}/data/{folder}")
        return folder, named.schema

    def discard(self, folder: str) -> None:
        p, files = _files(self.spark, f"{self.path}/data/{folder}")
        files.delete(p, True)

    def commit(self, batch: int, folder: str, schema: StructType) -> None:
        """Put a staged folder in force as a batch.  A batch that a compacted
        state already holds is not taken again."""

        def change(now: dict) -> dict:
            if now["upto"] is not None and batch <= now["upto"]:
                return now | {"retired": [*now["retired"], folder]}
            was = now["batches"].get(str(batch))
            return now | {"batches": now["batches"] | {str(batch): folder}, "schema": schema.jsonValue(), "retired": [*now["retired"], *([was] if was else [])]}

        self._publish(change)

    def write(self, mutations: DataFrame, batch: int, source=None) -> str:
        folder, schema = self.stage(mutations, f"batch-{batch}", source)
        self.commit(batch, folder, schema)
        return folder

    def exists(self) -> bool:
        now = self.manifest()
        return bool(now["batches"] or now["base"])

    def batches(self) -> list[int]:
        """Batches that no compacted state has taken in."""
        return sorted(int(b) for b in self.manifest()["batches"])

    def compacted(self) -> int | None:
        return self.manifest()["upto"]

    def read(self, version: int | None = None) -> DataFrame:
        """The log as of a version, the newest if none is given.  It stays
        readable until the second compaction after it."""
        return self._read(self.manifest(version))

    def _read(self, now: dict) -> DataFrame:
        folders = [*([now["base"]] if now["base"] else []), *now["batches"].values()]
        if not folders:
            raise ValueError(f"{self.path} has no batches")
        return self.folder(folders, StructType.fromJson(now["schema"]))

    def folder(self, folders: list[str], schema: StructType) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders]).select(*schema.names)

    def state(self, keys: list[str], tie: list[str]) -> DataFrame:
        """The newest mutation per source and key."""
        return merge.newest(self.read(), ["source", *keys], tie=tie)

    def rewrite(self, merged: Callable[[DataFrame], DataFrame]) -> None:
        """Put ``merged`` of all batches so far in their place, ``source``
        included.  Batches that arrive meanwhile stay in force beside it."""
        now = self.manifest()
        if not now["batches"]:
            return
        upto = max(int(b) for b in now["batches"])
        folder, schema = self.stage(merged(self._read(now)), f"upto-{upto}", "source")
        taken = [*([now["base"]] if now["base"] else []), *now["batches"].values()]
        old = list(now["retired"])

        def change(then: dict) -> dict:
            left = {b: f for b, f in then["batches"].items() if f not in taken}
            return then | {"upto": upto, "base": folder, "batches": left, "schema": schema.jsonValue(), "retired": [*[f for f in then["retired"] if f not in old], *taken]}

        self._publish(change)
        for f in old:  # what the compaction before this one replaced
            self.discard(f)

    def compact(self, keys: list[str], tie: list[str]) -> None:
        """Put the newest mutation per source and key in the place of all
        batches so far."""
        order = F.struct("wt", "del", *tie)
        self.rewrite(lambda log: log.groupBy("source", *keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("source", *keys)]), order).alias("w")).select("source", *keys, "w.*"))


@dataclass(frozen=True)
class Counters:
    """Where a stream counts what it has written: rows and rows in error (a
    condition) per group and batch."""

    path: str
    by: list[str]
    error: str

    def add(self, mutations: DataFrame, batch: int) -> None:
        each = mutations.groupBy(*self.by).agg(F.count("*").alias("replayed"), F.count_if(F.expr(self.error)).alias("errors"))
        each.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def read_counters(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Per group: all rows replayed, those of its last batch, and errors."""
    each = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return each.groupBy(*by).agg(F.sum("replayed").alias("replayed"), F.max_by("replayed", "batch").alias("last_batch"), F.sum("errors").alias("errors"))


def position(spark: SparkSession, checkpoint: str) -> int:
    """How many batches a query has finished: one more than the last one's
    number, because old commits are purged."""
    return max(_numbered(spark, f"{checkpoint}/commits"), default=-1) + 1


def tail(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream, by admission of files;
    new subfolders (ranges) are taken in as they appear."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def replicate(stream: DataFrame, log: MutationLog, checkpoint: str, derive: Callable[[DataFrame], DataFrame], forever_every: str | None = None, split_by: str | None = None, reject: str | None = None, counters: Counters | None = None):
    """Start replication.  Without ``forever_every`` the query takes all there
    is and stops (offline, and the last run of a cutover); with it the same
    checkpoint goes on, polling at that interval.

    ``split_by``, a column of the mutations, sends several tables through one
    query, each to its own part of the log.  ``reject`` is a condition of rows
    that cannot be written: a batch that has one fails, and the position stays
    before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        if reject:
            batch = batch.observe(seen, F.count_if(F.expr(reject)).alias("bad"))
        folder, schema = log.stage(derive(batch), f"batch-{batch_id}", split_by)
        if reject and seen.get["bad"]:
            log.discard(folder)
            raise ValueError(f"batch {batch_id} {REJECTED}")
        log.commit(batch_id, folder, schema)
        if counters:  # from what was written: the batch is not derived again
            counters.add(log.folder([folder], schema), batch_id)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=forever_every) if forever_every else writer.trigger(availableNow=True)).start()


def cut_over(query, ready: bool | DataFrame, job=None) -> str:
    """Drain a running query and stop it, if the job is ready; else leave it.
    ``ready`` may be the units of jobs, of which ``job`` is asked for."""
    if isinstance(ready, DataFrame):
        ready = not cutover_ready(ready).where((F.col("job") == F.lit(job)) & F.col("ready")).isEmpty()
    if not ready:
        return "Pending"
    query.processAllAvailable()
    query.stop()
    return "Completed"
