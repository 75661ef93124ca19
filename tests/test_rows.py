"""Golden cases of envelopes and mutations, and properties of the merge."""

import itertools

import pytest

from driftline.functions import cells as C
from driftline.operators import decode as D
from driftline.operators import merge
from driftline.operators import mutations as M
from driftline.operators import ranges

NOW = 1_000_000_000
KINDS = {"pk": "partition_key", "ck": "clustering", "v": "regular", "w": "regular", "st": "static", "s": "regular", "u": "regular", "l": "regular"}
CLASSES = {"v": "simple", "w": "simple", "st": "simple", "s": "set", "u": "udt", "l": "list"}


def decoded(spark, text):
    return D.decode(spark.createDataFrame([(text,)], "json string"), NOW)


def ops(spark, text):
    rows = M.plan(decoded(spark, text), KINDS, CLASSES, NOW).orderBy("seq", "wt").collect()
    return [(r["op"], r["column"], r["value"], r["wt"], r["expiry"]) for r in rows]


def test_full_insert(spark):
    got = ops(spark, '{"pk":"p","ck":1,"v":"a","__sys_rw_ts":100,"__sys_clts":{"v":100}}')
    assert [g[0] for g in got] == ["full_insert"] and got[0][3] == 100


def test_divergent_cell_leaves_the_baseline(spark):
    got = ops(spark, '{"pk":"p","ck":2,"v":"a","w":"b","__sys_rw_ts":100,"__sys_rw_ttl":[50,60],"__sys_clttl":[1000,{"w":[10,20]}],"__sys_clts":{"v":100,"w":200}}')
    assert ("set_group", "w", "b", 200, 1020) in got
    assert got[0][0] == "baseline" and '"w"' not in got[0][2] and got[0][4] == 1060


def test_set_elements_and_removals(spark):
    got = ops(spark, '{"pk":"p","ck":3,"s":[1,2,3],"__sys_rw_ts":100,"__sys_clts":{"s":[100,100,300]},"__sys_clts_tmbstn":{"s":[99,{"7":150,"8":null,"9":20}]}}')
    assert ("set_group", "s", '["1","2"]', 100, None) in got and ("add", "s", '["3"]', 300, None) in got
    assert [g for g in got if g[0] == "remove"] == [("remove", "s", '["7"]', 150, None)]


def test_deletion_that_is_not_implied(spark):
    got = ops(spark, '{"pk":"p","ck":3,"s":[1,2],"__sys_rw_ts":100,"__sys_clts":{"s":[250,300]},"__sys_clts_tmbstn":{"s":[200,{}]}}')
    assert ("set_group", "s", None, 201, None) in got and sum(g[0] == "add" for g in got) == 2


def test_count_mismatch_writes_uniformly(spark):
    got = ops(spark, '{"pk":"p","ck":3,"s":[1,2,3],"__sys_rw_ts":100,"__sys_clts":{"s":[100,300]}}')
    assert [g for g in got if g[1] == "s"] == [("set_group", "s", "[1,2,3]", 300, None)]


def test_udt_fields(spark):
    got = ops(spark, '{"pk":"p","ck":4,"u":{"hue":"teal","depth":12},"__sys_rw_ts":null,"__sys_clts":{"u":{"hue":100,"depth":640}},"__sys_clts_tmbstn":{"u":[99,{}]}}')
    assert got == [("set_group", "u", '{"hue":"teal"}', 100, None), ("field", "u", "12", 640, None)]


def test_list_runs(spark):
    got = ops(spark, '{"pk":"p","ck":5,"l":[1,2,3,4],"__sys_rw_ts":100,"__sys_clts":{"l":[100,100,100,100]},"__sys_clttl":[10,{"l":[[5,5],[5,5],[6,6],[7,7]]}]}')
    assert [g[2] for g in got if g[1] == "l"] == ['["1","2"]', '["3"]', '["4"]']
    assert len({g[3] for g in got if g[1] == "l"}) == 3


def test_static_only_partition(spark):
    rows = M.plan(decoded(spark, '{"pk":"p","ck":null,"st":"z","__sys_rw_ts":null,"__sys_clts":{"st":77}}'), KINDS, CLASSES, NOW).collect()
    assert [(r["column"], r["is_static"], r["wt"]) for r in rows] == [("st", True, 77)]


def test_null_cell_with_deletion(spark):
    assert ("set_group", "v", None, 55, None) in ops(spark, '{"pk":"p","ck":6,"v":null,"__sys_rw_ts":100,"__sys_clts":{"v":null},"__sys_clts_tmbstn":{"v":55}}')


@pytest.mark.parametrize("text, reason", [("[1]", "not an object"), ('{"a":1} x', "not an object"), ('{"a":1}{"b":2}', "trailing text"), ('{"__sys_rw_ttl":[-1,2]}', "negative ttl"), ('{"__sys_rw_ttl":[1]}', "ttl pair"), ('{"__sys_rw_ts":"x"}', "marker")])
def test_malformed(spark, text, reason):
    good, bad = D.split_malformed(spark.createDataFrame([(text,)], "json string"))
    assert good.count() == 0 and bad.first()["reason"] == reason


def test_marker_expiry(spark):
    for ttl, base, want in (("[50,2000]", 0, 2000), ("[50,0]", 0, NOW + 50), ("[50,500]", 1500, 2000), ("[0,5]", 0, None)):
        m = decoded(spark, f'{{"pk":"p","__sys_rw_ts":1,"__sys_rw_ttl":{ttl},"__sys_clttl":[{base},{{}}]}}').first()["marker"]
        assert m["expiry"] == want


def test_remaining_ttl(spark):
    e = spark.createDataFrame([(None,), (NOW - 5,), (NOW + 60,), (NOW + 700_000_000,)], "e bigint")
    from pyspark.sql import functions as F

    assert [r[0] for r in e.select(C.remaining_ttl(F.col("e"), NOW)).collect()] == [0, 1, 60, C.MAX_TTL]
    assert e.select(F.max(C.remaining_ttl(F.col("e") + 1_000_000_000, NOW, True))).first()[0] + NOW < C.LAST_SECOND


def test_merge_ignores_order_and_replay(spark):
    rows = [(1, 10, False, "a", None), (1, 10, True, None, None), (1, 9, False, "z", None), (2, 5, False, "b", 7), (2, 5, False, "c", None)]
    states = set()
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 17):
        df = spark.createDataFrame([*order, order[0]], "k int, wt int, del boolean, val string, expiry int")
        states.add(tuple(sorted((r["k"], r["val"] or "", r["wt"], r["del"]) for r in merge.newest(df, ["k"]).collect())))
    assert states == {((1, "", 10, True), (2, "c", 5, False))}


def test_resume_point_rereads_the_first_page_that_is_not_done(spark):
    p = spark.createDataFrame([(0, 1, True), (0, 2, False), (0, 3, True), (1, 1, True)], "r int, seq int, done boolean")
    assert {r["r"]: r["next_seq"] for r in ranges.safe_resume_point(p, ["r"]).collect()} == {0: 2, 1: 2}
