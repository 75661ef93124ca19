"""A mutation log whose compacted state is dealt into buckets of keys.

Batches are written as they come.  ``collect`` merges those that have arrived
into the buckets that they touch, and leaves every other bucket as it is; so
its work follows what has changed, not what the log holds.  With a horizon it
also collects deletions and expired cells up to it, in touched buckets and in
those that are due: a version knows each bucket's earliest deletion and expiry.

A horizon promises that older atoms have arrived.  One that comes later all the
same could revive what was collected; it is kept aside (``late``), not merged.

Scale: which buckets are touched is an aggregate of at most ``buckets`` rows,
as is what a version says of them.  Compacted rows are rebalanced by bucket, so
that a hot bucket is written by many tasks and small ones share a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.operators import apply
from driftline.streaming.replicate import MutationLog, _numbered


class BucketedLog(MutationLog):
    """Atoms (see ``operators.apply``) of the rows named by ``keys``.  Another
    number of buckets than before deals the whole log anew at the next
    collection."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 256) -> None:
        super().__init__(spark, path)
        self.keys, self.buckets = ["source", *keys], buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _schema(self, now: dict) -> StructType:
        """An atom's columns; others that a batch has are not kept."""
        names = [*self.keys, *apply.PLACE, *apply.FACTS]
        return StructType([f for f in StructType.fromJson(now["schema"]) if f.name in names])

    def rewrite(self, merged) -> None:
        raise TypeError("a bucketed log is kept small by collect")

    def exists(self) -> bool:
        now = self.manifest()
        return bool(now["batches"] or now.get("parts"))

    def _arrived(self, now: dict) -> tuple[DataFrame, DataFrame] | None:
        """(on time, late) of the batches that no bucket has taken in."""
        if not now["batches"]:
            return None
        rows = self.folder(list(now["batches"].values()), self._schema(now))
        return (rows, rows.limit(0)) if now.get("horizon") is None else apply.late(rows, now["horizon"])

    def _rows(self, parts: dict, arrived: tuple | None, schema: StructType) -> DataFrame:
        """Buckets and what came on time.  Their folders are not as deep, so
        they are two reads."""
        each = [self.folder([f"{p['folder']}/_bucket={b}" for b, p in parts.items()], schema)] if parts else []
        each += [arrived[0]] if arrived else []
        return each[0] if len(each) == 1 else each[0].union(each[1]) if each else self.spark.createDataFrame([], schema)

    def _read(self, now: dict) -> DataFrame:
        if not now["schema"]:
            raise ValueError(f"{self.path} has no batches")
        return self._rows(now.get("parts", {}), self._arrived(now), self._schema(now))

    def late(self) -> DataFrame:
        """Atoms that came after the horizon had passed them."""
        now = self.manifest()
        schema = self._schema(now)
        arrived, kept = self._arrived(now), now.get("late", [])
        each = ([self.folder(kept, schema)] if kept else []) + ([arrived[1]] if arrived else [])
        return each[0] if len(each) == 1 else each[0].union(each[1]) if each else self.spark.createDataFrame([], schema)

    def _deal(self, rows: DataFrame, folder: str, schema: StructType) -> dict:
        """Write rows by bucket; what a version says of each bucket."""
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket", "source").parquet(f"{self.path}/data/{folder}")
        written = _numbered(self.spark, f"{self.path}/data/{folder}", "_bucket=")
        if not written:
            return {}
        gone = F.min(F.when(F.col("del"), F.col("wt")))
        ends = F.min(F.when(~F.col("del") & F.col("expiry").isNotNull(), F.greatest("wt", F.col("expiry") * 1_000_000)))
        facts = self.folder([f"{folder}/_bucket={b}" for b in written], schema).groupBy(self._bucket().alias("b")).agg(gone.alias("gone"), ends.alias("ends"))
        return {str(r["b"]): {"folder": folder, "gone": r["gone"], "ends": r["ends"]} for r in facts.collect()}

    def collect(self, horizon: int | None = None, now: int | None = None) -> int:
        """Take in the batches so far, and collect what lies at or before the
        horizon (microseconds; it never goes back): deletions, and with ``now``
        (seconds) cells that have expired.  Returns how many buckets were
        rewritten.  Readers keep what they have begun with until the collection
        after this one; batches that arrive meanwhile stay beside it."""
        then = self.manifest()
        if not then["schema"]:
            return 0
        schema, parts = self._schema(then), then.get("parts", {})
        bar = max((h for h in (then.get("horizon"), horizon) if h is not None), default=None)
        arrived, taken, replaced = self._arrived(then), list(then["batches"].values()), list(then["retired"])

        def due(p: dict) -> bool:
            passed = lambda t: t is not None and bar is not None and t <= bar
            return passed(p["gone"]) or now is not None and passed(p["ends"]) and p["ends"] <= now * 1_000_000

        touched = {str(r["b"]) for r in arrived[0].select(self._bucket().alias("b")).distinct().collect()} if arrived else set()
        anew = then.get("of", self.buckets) != self.buckets
        old = {b: p for b, p in parts.items() if anew or b in touched or due(p)}
        folder, staged = f"at=upto-{then['version']}-{uuid.uuid4().hex[:8]}", []
        try:
            new = {}
            if touched or old:
                staged.append(folder)
                new = self._deal(apply.compact(self._rows(old, arrived, schema), self.keys, bar, now).select(*schema.names), folder, schema)
            strays = []
            if arrived and not arrived[1].isEmpty():
                strays = [self.stage(arrived[1], "late", "source")[0]]
                staged += strays

            def change(m: dict) -> dict:
                if m.get("parts", {}) != parts:
                    raise RuntimeError(f"{self.path}: another collection was first")
                last = [int(b) for b, f in m["batches"].items() if f in taken]
                return m | {
                    "upto": max([*last, *([] if m["upto"] is None else [m["upto"]])], default=None), "batches": {b: f for b, f in m["batches"].items() if f not in taken},
                    "parts": {b: p for b, p in parts.items() if b not in old} | new, "of": self.buckets, "horizon": bar, "late": [*m.get("late", []), *strays],
                    "retired": [*[f for f in m["retired"] if f not in replaced], *taken, *[f"{p['folder']}/_bucket={b}" for b, p in old.items()]],
                }

            self._publish(change)
        except BaseException:
            for f in staged:
                self.discard(f)
            raise
        for f in replaced:  # what the collection before this one replaced
            self.discard(f)
        return len(set(old) | touched)
