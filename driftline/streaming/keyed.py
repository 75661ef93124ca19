"""The target's state kept in the stream itself, key by key.

Where ``replicate`` appends to a log that is merged when it is read, this keeps
each row's places (see ``operators.apply``) in the state store and passes on
what changes: a place that is set, or one that is gone because something
deleted, cleared or outlived it.  A row's earliest expiry is a timer.  What has
expired stays as a deletion of its time, so older rows that come late lose to
it.  No watermark is used, for nothing is too late.

Scale: rows are shuffled once, by key; a task holds one row's places at a time,
and the store (RocksDB) holds the rest on disk, with its changes in the
checkpoint.  Python is called once per key and batch, with plain rows: a frame
per key would cost more than its few rows.  An expiry that is past on arrival
sets no timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructType

from driftline.operators.apply import CELL, CLEAR, FACTS, MARKER, PLACE, ROW

#: What the store must be.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What is passed on beside the key and the place.
CHANGE = "value: string, wt: long, expiry: long, gone: boolean"


def order(a: tuple) -> tuple:
    """How atoms (value, wt, expiry, del) of one place outrank each other."""
    value, wt, expiry, gone = a
    return wt, gone, value is not None, value or "", expiry is None, expiry or 0


def visible(places: dict) -> dict:
    """Places of cells and markers that are there: neither deleted nor shadowed."""
    never = -(2**63)
    row = max((a[1] for p, a in places.items() if p[0] == ROW), default=never)
    cleared = {p[1]: a[1] for p, a in places.items() if p[0] == CLEAR}
    return {p: a for p, a in places.items() if p[0] in (CELL, MARKER) and not a[3] and a[1] > row and (p[0] == MARKER or a[1] > cleared.get(p[1], never))}


def outlive(places: dict, now: int) -> None:
    """What is there and has expired by ``now`` becomes a deletion of its time."""
    for p, (_, wt, expiry, _gone) in visible(places).items():
        if expiry is not None and expiry <= now:
            places[p] = (None, wt, None, True)


class Rows(StatefulProcessor):
    """One row's places, as JSON, and a timer at its earliest expiry."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("places", StructType().add("places", StringType()).add("timer", LongType()))

    def _load(self) -> tuple[dict, int | None]:
        held = self.held.get()
        if held is None:
            return {}, None
        text, timer = held
        return {tuple(x[:3]): tuple(x[3:]) for x in json.loads(text)}, timer

    def _keep(self, places: dict, timer: int | None) -> None:
        soonest = min((a[2] for a in visible(places).values() if a[2] is not None), default=None)
        if soonest != timer:
            if timer is not None:
                self.handle.deleteTimer(timer * 1000)
            if soonest is not None:
                self.handle.registerTimer(soonest * 1000)
        self.held.update((json.dumps([[*p, *a] for p, a in places.items()]), soonest))

    @staticmethod
    def _changes(key: tuple, before: dict, after: dict) -> Iterator[Row]:
        """One row with all that changes: a batch is sent for each key."""
        changes = [(*p, *a[:3], False) for p, a in after.items() if before.get(p) != a]
        changes += [(*p, None, a[1], None, True) for p, a in before.items() if p not in after]
        if changes:
            names = [*PLACE, "value", "wt", "expiry", "gone"]
            yield Row(**{f"k{i}": k for i, k in enumerate(key)}, changes=[dict(zip(names, c)) for c in changes])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        places, timer = self._load()
        before = visible(places)
        for row in rows:
            a = row["atom"]
            place, atom = tuple(a[c] for c in PLACE), (a["value"], a["wt"], a["expiry"], a["del"])
            if place not in places or order(atom) > order(places[place]):
                places[place] = atom
        # what is due needs no timer, nor to be passed on as set before it goes
        outlive(places, timerValues.getCurrentProcessingTimeInMs() // 1000)
        self._keep(places, timer)
        yield from self._changes(key, before, visible(places))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        places, timer = self._load()
        # all that is due by now: a timer set here would wait for the next batch
        before, now = visible(places), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()) // 1000
        outlive(places, now)
        self._keep(places, None if timer is not None and timer <= now else timer)
        yield from self._changes(key, before, visible(places))

    def close(self) -> None:
        pass


def changes(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of atoms as a stream of what changes in the target: keys, scope,
    column, path, value, wt, expiry, gone."""
    atoms.sparkSession.conf.set(*ROCKSDB)
    kinds = ", ".join(f"k{i} {atoms.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    places = ", ".join(f"{c}: string" for c in PLACE)
    named = atoms.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*PLACE, *FACTS).alias("atom"))
    out = named.groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithState(statefulProcessor=Rows(), outputStructType=f"{kinds}, changes array<struct<{places}, {CHANGE}>>", outputMode="Update", timeMode="ProcessingTime")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.inline("changes"))


def keep(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that writes each batch's changes to a folder of its own,
    which it writes anew when it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    # timers alone don't go on for ever: a run ends when its input does
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        conf.set(name, was)


def target(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What the changes so far leave: keys, column, path, value, wt, expiry.  A
    place may change twice in a batch (set, then expired): gone is last."""
    log = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = log.groupBy(*keys, *PLACE).agg(F.max_by(F.struct("value", "wt", "expiry", "gone"), F.struct("batch", "wt", "gone")).alias("c"))
    return last.where("not c.gone").select(*keys, "column", "path", "c.value", "c.wt", "c.expiry")
