"""What is done per key or per round must not grow faster than the input."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftline.operators import catalog as K
from driftline.operators import graph as G
from driftline.operators.apply import CELL
from driftline.plans import registry
from driftline.sources import scratch
from driftline.streaming import keyed as Y

SMALL = "/root/testdata/sf0.001"


class Held:
    """A processor's handle that counts what is asked of the store."""

    def __init__(self) -> None:
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value) -> None:
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at) -> None:
        self.calls.append(("timer", at))

    def deleteTimer(self, at) -> None:
        self.calls.append(("no timer", at))


def test_a_key_costs_two_calls_and_one_row(spark):
    rows, held = Y.Rows(), Held()
    rows.init(held)
    atom = lambda path, wt, expiry: Row(atom={"scope": CELL, "column": "c", "path": path, "value": "v", "wt": wt, "expiry": expiry, "del": False})
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 50_000)
    (out,) = rows.handleInputRows((1, None), iter([atom("a", 1, None), atom("b", 2, 49), atom("c", 3, 50)]), clock)
    # what has expired is neither passed on as set nor given a timer
    assert held.calls == ["get", "update"] and (out.k0, out.k1) == (1, None) and [c["path"] for c in out.changes] == ["a"]
    # and older atoms that come late lose to it; what expires later has a timer
    (out,) = rows.handleInputRows((1, None), iter([atom("b", 1, None), atom("d", 4, 60)]), clock)
    assert held.calls[2:] == ["get", ("timer", 60_000), "update"] and [(c["path"], c["gone"]) for c in out.changes] == [("d", False)]


def test_compaction_plans_its_envelopes_once(spark):
    df = registry.QUERIES["compact_mutations"](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "from_json" not in plan and df.count() > 0


def test_a_catalog_is_not_broadcast(spark):
    plan = registry.QUERIES["anti_missing_columns"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_each_reachable_pair_is_written_once(spark, monkeypatch, seed):
    rng, written = random.Random(seed), []
    # cycles, loops, several ways, repeats, nulls, and a chain of 40
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(14)] + [(100 + i, 101 + i) for i in range(40)] + [(3, None), (3, None), (None, 5)]

    def counted(write):
        def run(df, to):
            written.append(df.count())
            return write(df, to)

        return run

    for name in ("append", "stage"):
        monkeypatch.setattr(K, name, counted(getattr(scratch, name)), raising=False)
    got = [tuple(r) for r in K.reachable(spark.createDataFrame(edges, "src int, dst int")).collect()]
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b is not None and b == c} - want:
        want |= more
    assert len(got) == len(want) == sum(written) and set(got) == want


def test_knots_behind_each_other_take_few_jobs(spark):
    # 40 rings of three, each of which needs the next, and below them a chain; two hang off it
    edges = [(3 * i + j, 3 * i + (j + 1) % 3) for i in range(40) for j in range(3)] + [(3 * i, 3 * i + 3) for i in range(40)]
    edges += [(120 + i, 121 + i) for i in range(6)] + [(200, 0), (201, 123), (202, 202), (202, 121)]
    table = scratch.stage(spark.createDataFrame(edges, "src long, dst long"), "edges")
    sc = spark.sparkContext
    sc.setJobGroup("knots", "")
    try:
        got = {r["node"]: (r["level"], r["component"], r["on_cycle"]) for r in G.dependency_order(table, G.ends(table)).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("knots"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    want = {n: (None, n - n % 3, True) for n in range(120)} | {n: (126 - n, n, False) for n in range(120, 127)}
    assert got == want | {200: (None, 200, False), 201: (4, 201, False), 202: (None, 202, True)}
    assert jobs < 150


def test_components_of_texts_and_without_ways(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("d", "d")], "src string, dst string")
    assert sorted(tuple(r) for r in G.components(edges).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
    assert [tuple(r) for r in G.components(edges.where("src = 'd'")).collect()] == [("d", "d")]
    assert G.components(edges.where("false")).collect() == []


def test_few_rows_are_read_by_few_tasks(spark):
    table, got = scratch.observed(spark.range(100).repartition(4), "few", top=F.max("id"))
    assert got == {"rows": 100, "top": 99} and table.rdd.getNumPartitions() == 1 and table.count() == 100
    table, got = scratch.observed(spark.range(0).selectExpr("id"), "none")
    assert got["rows"] == 0 and table.count() == 0
