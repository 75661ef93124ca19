"""Queries and operators do the whole job: cases that a cut would lose."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from driftline.operators import catalog as K
from driftline.operators import decode as D
from driftline.operators import graph as G
from driftline.operators import mutations as M
from driftline.operators import ranges, recon
from driftline.plans import registry
from driftline.sources import tables as T
from driftline.streaming import replicate as R

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def ancestors(n):
    while n := n // 3:
        yield n


def test_edges_are_of_all_parts(spark):
    parts = [r[0] for r in spark.read.parquet(f"{MID}/part.parquet").select("p_partkey").collect()]
    assert max(parts) > 300
    pairs = registry.QUERIES["reachable_nodes"](spark, MID).collect()
    assert sorted((r["src"], r["dst"]) for r in pairs) == sorted((n, a) for n in parts for a in ancestors(n))
    nodes = {n for n in parts if n >= 3} | {n // 3 for n in parts if n >= 3}
    levels = registry.QUERIES["dependency_levels"](spark, MID).collect()
    assert sorted((r["node"], r["level"]) for r in levels) == sorted((n, len(list(ancestors(n)))) for n in nodes)


def test_deep_chains_keep_their_levels(spark):
    edges = spark.createDataFrame([(n, n - 1) for n in range(1, 36)] + [(100, 101), (101, 100), (102, 100)], "src long, dst long")
    nodes = edges.selectExpr("src as node").union(edges.selectExpr("dst")).distinct()
    got = {r["node"]: r["level"] for r in K.dependency_levels(edges, nodes).collect()}
    assert got == {n: n for n in range(36)} | {100: None, 101: None, 102: None}


def test_components_of_random_graphs_equal_plain_search(spark):
    dice = random.Random(5)
    pairs = {(dice.randrange(40), dice.randrange(40)) for _ in range(36)}  # sparse, then dense
    pairs |= {(40 + dice.randrange(40), 40 + dice.randrange(40)) for _ in range(60)}
    nodes = range(84)  # four of them without edges
    to = {n: {b for a, b in pairs if a == n} for n in nodes}
    reach = {n: set(to[n]) for n in nodes}
    for _ in nodes:
        reach = {n: reach[n].union(*(reach[m] for m in reach[n])) for n in nodes}
    cyclic = {n for n in nodes if n in reach[n]}
    height = lambda n: 1 + max(map(height, to[n])) if to[n] else 0
    want = {n: (None if n in cyclic or reach[n] & cyclic else height(n), min({n} | {m for m in reach[n] if n in reach[m]}), n in cyclic) for n in nodes}
    edges = spark.createDataFrame([*pairs, *list(pairs)[:5], (None, 3), (4, None)], "src long, dst long")
    got = G.dependency_order(edges, spark.range(84).toDF("node")).collect()
    assert {r["node"]: (r["level"], r["component"], r["on_cycle"]) for r in got} == want and len(got) == 84


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = G._needs
    monkeypatch.setattr(G, "_needs", lambda e: rounds.append(1) or real(e))
    edges = spark.range(1, 1001).selectExpr("id as src", "id - 1 as dst")
    ring = spark.range(2000, 2100).selectExpr("id as src", "if(id = 2099, 2000, id + 1) as dst")
    both = edges.union(ring).union(spark.sql("select 5000L, 2000L"))
    got = {r["node"]: (r["level"], r["component"]) for r in G.dependency_order(both, G.ends(both)).collect()}
    assert got == {n: (n, n) for n in range(1001)} | {n: (None, 2000) for n in range(2000, 2100)} | {5000: (None, 5000)}
    assert len(rounds) < 40


def test_no_edges_place_all_nodes(spark):
    got = G.dependency_order(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("a",), ("a",), ("b",)], "node string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, "a", False), ("b", 0, "b", False)]


def test_null_split_values_stay_in_the_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None), (5, "None")], "seq long, kind string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = R.MutationLog(spark, str(tmp_path / "log"))
    R.replicate(R.tail(spark, str(tmp_path / "in"), rows.schema), log, str(tmp_path / "checkpoint"), lambda b: b, split_by="kind").awaitTermination()
    assert sorted((r["seq"], r["source"]) for r in log.read().collect()) == [(1, "a"), (2, None), (3, "b"), (4, None), (5, "None")]


def test_poison_policy_counts_what_the_log_has(spark, monkeypatch):
    real = R.replicate

    def after_a_write(stream, log, *args, **kw):
        if not log.exists():
            log.write(spark.range(7).selectExpr("id as seq"), 99)
        return real(stream, log, *args, **kw)

    def broken(stream, log, checkpoint, derive, **kw):
        return real(stream, log, checkpoint, lambda b: b.select("no_such_column"))

    rows = spark.read.parquet(f"{SMALL}/events.parquet").count()
    run = lambda: registry.QUERIES["poison_policy"](spark, SMALL).first()
    assert (got := run()) and (got["stopped"], got["written"], got["position"], got["repaired"]) == (True, 0, 0, rows)
    monkeypatch.setattr(R, "replicate", after_a_write)
    assert run()["written"] == 7
    monkeypatch.setattr(R, "replicate", broken)
    with pytest.raises(StreamingQueryException):
        run()


def test_log_survives_compaction(spark, tmp_path):
    log = R.MutationLog(spark, str(tmp_path / "log"))
    rows = lambda *x: spark.createDataFrame(x, "pk long, wt long, seq long, val string, expiry long, del boolean")
    log.write(rows((1, 10, 1, "a", None, False), (2, 10, 2, "b", None, False)), 0)
    log.write(rows((1, 20, 3, "c", None, False), (2, 5, 4, "late", None, True)), 1)
    want = sorted(map(tuple, log.state(["pk"], ["seq"]).collect()))
    log.compact(["pk"], ["seq"])
    assert log.batches() == [] and log.compacted() == 1 and log.read().count() == 2
    assert sorted(map(tuple, log.state(["pk"], ["seq"]).collect())) == want
    log.write(rows((1, 20, 3, "c", None, False)), 1)  # a batch that the state has runs again
    log.write(rows((2, 30, 5, None, None, True)), 2)
    log.compact(["pk"], ["seq"])
    assert {(r["pk"], r["val"], r["del"]) for r in log.read().collect()} == {(1, "c", False), (2, None, True)}


def test_pages_go_on_within_equal_keys(spark):
    rows = spark.createDataFrame([(p, s) for p in (1, 2) for s in range(5)], "p long, s long")
    seen, after = [], {"p": None, "s": None}
    while got := ranges.page(rows, after, 3).collect():
        seen += [(r["p"], r["s"]) for r in got]
        after = got[-1]["next"].asDict()
    assert seen == [(p, s) for p in (1, 2) for s in range(5)]


def test_ranges_ends_and_unknowns(spark):
    with pytest.raises(ValueError):
        ranges.required_ranges(spark.createDataFrame([(None,), ("",)], "range_id string"))
    log = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, m string")
    assert sorted(r["m"] for r in ranges.head_and_tail(log, ["k"], 2, 5).collect()) == ["x", "x", "y"]
    assert ranges.log_page(log, ["k"], 0, 0).count() == 1
    assert [r["rows"] for r in T.row_count(None).collect()] == [-1] and T.has_data(lambda: spark.read.parquet("/no/such/table"))
    both = recon.recon_rows(spark.createDataFrame([(None, 1), (2, 1)], "k long, v long"), spark.createDataFrame([(None, 1), (3, 1)], "k long, v long"), ["k"], ["v"])
    assert sorted((r["state"], r["k"]) for r in both.collect()) == [("equal", None), ("extra", 3), ("missing", 2)]


def test_failure_runs_cross_spans(spark):
    import random

    r = random.Random(4)
    rows = [(k, n, r.random() < 0.1 + 0.2 * k) for k in range(4) for n in range(300)] + [(9, n, True) for n in range(40)]
    want = {}
    for k in {x[0] for x in rows}:
        run = best = 0
        for _, _, bad in sorted(x for x in rows if x[0] == k):
            run = run + 1 if bad else 0
            best = max(best, run)
        want[k] = best
    df = spark.createDataFrame(rows, "k long, n long, bad boolean")
    for span in (7, 1000):
        assert {x["k"]: x["longest"] for x in ranges.failure_runs(df, ["k"], "n", "bad", 3, span).collect()} == want


def test_scan_of_one_range_reads_its_folder(spark, tmp_path):
    spark.range(100).selectExpr("id % 4 as range_id", "id").write.partitionBy("range_id").parquet(str(tmp_path / "t"))
    df = ranges.scan_range(spark, str(tmp_path / "t"), 3)
    assert df.count() == 25 and len(df.inputFiles()) > 0
    assert "PartitionFilters: [isnotnull(range_id" in df._jdf.queryExecution().executedPlan().toString()


def test_envelopes_are_parsed_once(spark):
    plan = lambda name: registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("cell_divergence").count("from_json") <= 16 and plan("plan_baseline").count("from_json") <= 20


def test_a_deleted_row_is_not_a_full_insert(spark):
    rows = spark.createDataFrame([('{"pk":1,"v":2,"__sys_rw_ts":5000000,"__sys_rw_tmbstn":4000000}',), ('{"pk":2,"v":2,"__sys_rw_ts":5000000}',)], "json string")
    got = M.plan(D.decode(rows, 100), {"pk": "partition_key", "v": "regular"}, {"v": "simple"}, 100)
    assert sorted((r["op"], r["wt"]) for r in got.collect()) == [("baseline", 5000000), ("full_insert", 5000000), ("row_delete", 4000000)]


@pytest.mark.parametrize("name", ["scan_typed_orders", "project_by_name_orders", "drop_and_reload_orders", "scan_catalog_tables_customer", "scan_catalog_columns_part"])
def test_work_grows_with_the_tables(spark, name):
    assert registry.QUERIES[name](spark, MID).count() > 2 * registry.QUERIES[name](spark, SMALL).count() > 0
