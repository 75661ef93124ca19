"""The bucketed log: brute force, what a collection rewrites, and late atoms."""

import os

import pytest
from pyspark.sql import functions as F
from test_replay import LOG, plain_state, random_atoms

from driftline.operators import apply as A
from driftline.operators import progress
from driftline.streaming import replicate as R
from driftline.streaming.bucketed import BucketedLog


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def state(log):
    return sorted(map(tuple, A.state(log.read(), ["source", "k"]).drop("source").where("not del").collect()), key=repr)


def put(spark, log, batch, keys, value, wt, gone=False):
    log.write(frame(spark, [(k, "cell", "a", "x", None if gone else value, wt, None, gone) for k in keys]), batch)


def files(log):
    return {os.path.join(at, f) for at, _, names in os.walk(f"{log.path}/data") for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, tmp_path, seed):
    rows = random_atoms(seed, 150)
    log = BucketedLog(spark, str(tmp_path / "log"), ["k"], buckets=4)
    for batch, (low, high) in enumerate([(0, 10), (10, 20), (20, 30)]):
        log.write(frame(spark, [a for a in rows if low < a[5] <= high]), batch)
        log.collect(horizon=high - 5 if batch < 2 else None)
    assert state(log) == [c for c in plain_state(rows) if not c[-1]]
    log.write(frame(spark, [a for a in rows if a[5] <= 15]), 3)  # all of it once more, too late
    assert log.late().count() == sum(a[5] <= 15 for a in rows)
    log.collect(horizon=30)
    assert state(log) == [c for c in plain_state(rows) if not c[-1]] and log.read().where("del").isEmpty()
    assert log.late().count() == sum(a[5] <= 15 for a in rows)  # kept aside, not lost


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    log = BucketedLog(spark, str(tmp_path / "log"), ["k"], buckets=16)
    put(spark, log, 0, range(200), "old", 1)
    assert log.collect() == 16
    before = log.manifest()["parts"]
    put(spark, log, 1, [7], "new", 2)
    assert log.collect() == 1
    after = log.manifest()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["value"]: r["count"] for r in log.read().groupBy("value").count().collect()} == {"old": 199, "new": 1}
    assert log.collect() == 0  # nothing arrived, nothing is due


def test_bounded_under_overwrites(spark, tmp_path):
    log, sizes = BucketedLog(spark, str(tmp_path / "log"), ["k"], buckets=4), []
    for batch in range(6):
        put(spark, log, batch, range(40), str(batch), batch * 10 + 1)
        put(spark, log, 100 + batch, range(40, 60), None, batch * 10 + 2, gone=True)
        log.collect(horizon=batch * 10 + 5)
        sizes.append((log.read().count(), len(files(log))))
    assert {rows for rows, _ in sizes} == {40}
    assert max(n for _, n in sizes[2:]) <= max(n for _, n in sizes[:3]) + 4


def test_untouched_buckets_are_collected_when_due(spark, tmp_path):
    log = BucketedLog(spark, str(tmp_path / "log"), ["k"], buckets=8)
    put(spark, log, 0, range(30), "v", 1)
    put(spark, log, 1, [5], None, 3_000_000, gone=True)
    log.write(frame(spark, [(6, "cell", "a", "x", "short", 2_000_000, 4, False)]), 2)
    log.collect()
    assert log.read().count() == 30
    assert log.collect(horizon=3_500_000, now=10) == 1  # the deletion; the other expires past the horizon
    assert log.collect(horizon=4_500_000, now=3) == 0  # nor before it has expired
    assert log.collect(horizon=4_500_000, now=10) == 1
    assert sorted(r["k"] for r in log.read().collect()) == [k for k in range(30) if k not in (5, 6)]


def test_readers_batches_and_other_collections_meanwhile(spark, tmp_path):
    log = BucketedLog(spark, str(tmp_path / "log"), ["k"], buckets=4)
    put(spark, log, 0, range(20), "a", 1)
    log.collect()
    put(spark, log, 1, range(10), "b", 2)
    reader = log.read()  # 20 and 10 rows
    log.collect()
    assert reader.count() == 30 and log.read().count() == 20
    put(spark, log, 1, range(10), "again", 9)  # a batch that was taken in, run again
    assert log.read().where("value = 'again'").isEmpty()

    other, deal = BucketedLog(spark, log.path, ["k"], buckets=4), log._deal

    def slow(*args):
        put(spark, other, 3, [0], "d", 4)
        other.collect()
        return deal(*args)

    put(spark, log, 2, [1], "c", 3)
    log._deal = slow
    with pytest.raises(RuntimeError, match="first"):
        log.collect()
    assert {r["k"]: r["value"] for r in log.read().where("k < 2").collect()} == {0: "d", 1: "c"}


def test_other_numbers_of_buckets_nulls_and_sources(spark, tmp_path):
    path, rows = str(tmp_path / "log"), [(None, "cell", "a", "x", "n", 1, None, False), (1, "cell", "a", "x", "v", 1, None, False)]
    log = BucketedLog(spark, path, ["k"], buckets=4)
    for batch, name in enumerate(["s", "t", None]):
        log.write(frame(spark, rows).withColumn("of", F.lit(name).cast("string")), batch, "of")
    log.collect()
    assert BucketedLog(spark, path, ["k"], buckets=32).collect() >= 1
    assert log.manifest()["of"] == 32 and log.read().groupBy("source").count().where("count = 2").count() == 3
    with pytest.raises(TypeError):
        log.compact(["k"], ["wt"])


def test_nothing(spark, tmp_path):
    log = BucketedLog(spark, str(tmp_path / "log"), ["k"])
    assert log.collect() == 0 and not log.exists()
    with pytest.raises(ValueError):
        log.read()
    log.write(frame(spark, []), 0)
    assert log.collect(horizon=5) == 0 and log.read().isEmpty() and log.late().isEmpty()
    put(spark, log, 1, [1], None, 7, gone=True)
    assert log.collect(horizon=8) == 1 and log.read().isEmpty()


def test_as_the_log_of_a_stream(spark, tmp_path):
    root, rows = str(tmp_path), random_atoms(4, 120)
    log = BucketedLog(spark, f"{root}/log", ["k"], buckets=4)
    schema = frame(spark, []).schema
    for low, high in ((0, 15), (15, 30)):  # the second run goes on behind a collection
        frame(spark, [a for a in rows if low < a[5] <= high]).write.mode("append").parquet(f"{root}/in")
        R.replicate(R.tail(spark, f"{root}/in", schema), log, f"{root}/checkpoint", lambda b: b, reject="wt > 99").awaitTermination()
        log.collect(horizon=high)
    assert state(log) == [c for c in plain_state(rows) if not c[-1]] and R.position(spark, f"{root}/checkpoint") == 2


def test_event_lag(spark):
    rows = [("a", 5_000_000, True, 90), ("a", 9_500_000, False, 95), ("b", 7_000_000, None, 80), (None, 99_999_999, True, 99)]
    out = progress.event_lag(spark.createDataFrame(rows, "r string, wt long, done boolean, polled long"), ["r"], 100)
    assert {tuple(x) for x in out.collect()} == {("a", 5, 95, 4), ("b", 20, None, None), (None, 1, 0, 0)}
