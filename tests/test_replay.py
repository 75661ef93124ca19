"""Strict decoding, applied mutations, the versioned log, pages with nulls,
trees of digests and prefix scans: properties and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import apply as A
from driftline.operators import catalog as K
from driftline.operators import decode as D
from driftline.operators import mutations as M
from driftline.operators import ranges, recon
from driftline.operators import scan as S
from driftline.plans import row_queries as Q
from driftline.sources import tables as T
from driftline.streaming import replicate as R

NOW = 1_000_000_000
KINDS = {"pk": "partition_key", "ck": "clustering", "v": "regular", "st": "static", "s": "regular", "m": "regular", "u": "regular", "l": "regular"}
CLASSES = {"v": "simple", "st": "simple", "s": "set", "m": "map", "u": "udt", "l": "list"}


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "json string")


def test_texts_of_any_length(spark):
    long = "x\\\"y{" * 2_000_000  # 10 MB
    row = D.decode(frame(spark, '{"pk":"p","v":"' + long + '","__sys_rw_ts":5}'), NOW).select(F.length(F.col("clean")["v"]).alias("n"), "marker.wt").first()
    assert (row["n"], row["wt"]) == (len(long) - 2_000_000, 5)


@pytest.mark.parametrize("detail", ["9", '"x"', "true"])
def test_details_of_other_types_are_rejected(spark, detail):
    assert D.split_malformed(frame(spark, f'{{"__sys_clttl":[5,{{"v":{detail}}}]}}'))[1].first()["reason"] == "cell ttl detail"


@pytest.mark.parametrize("member, reason", [
    ('"__sys_rw_ts":1.5', "marker"), ('"__sys_rw_ts":[1]', "marker"), ('"__sys_rw_ttl":{}', "ttl pair"), ('"__sys_rw_ttl":[1,2,3]', "ttl pair"), ('"__sys_rw_ttl":["1",2]', "ttl pair"), ('"__sys_rw_ttl":[1,null]', "ttl pair"),
    ('"__sys_clttl":7', "cell ttl shape"), ('"__sys_clttl":[null,{}]', "cell ttl base"), ('"__sys_clttl":[5,{"v":[null,4]}]', "cell ttl start"), ('"__sys_clttl":[5,{"v":[[3,4],5]}]', "cell ttl element"),
    ('"__sys_clttl":[5,{"v":{"k":"x"}}]', "cell ttl field"), ('"__sys_clttl":[5,{"v":[3]}]', "cell ttl pair"), ('"__sys_clttl":[5,{"v":{"k":[1]}}]', "cell ttl pair"), ('"__sys_clttl":[5,{"v":[-3,4]}]', "negative cell ttl"),
])
def test_rejections(spark, member, reason):
    good, bad = D.split_malformed(frame(spark, '{"pk":1,' + member + "}"))
    assert good.isEmpty() and bad.first()["reason"] == reason and bad.columns == ["json", "reason"]


def test_odd_shapes_are_tolerated(spark):
    text = '{"pk":1,"v":2,"w":[1],"__sys_rw_ts":null,"__sys_rw_ttl":null,"__sys_clttl":[5,{"v":null,"w":[]}],"__sys_clts":{"\\"V\\"\\"x\\"":7,"v":"x","w":[3,"y",[9]],"o":{}},"__sys_clts_tmbstn":{"v":"z","w":[null,{"a":"q"}],"o":[4]},"__sys_other":{"a":1}}'
    row = D.decode(frame(spark, text), NOW).first().asDict(recursive=True)
    assert row["marker"] is None and row["latest_wt"] == 9 and set(row["clean"]) == {"pk", "v", "w"}
    assert {k: c["wt"] for k, c in row["all_cells"].items()} == {'V"x': 7, "w": 9}
    assert {k: (d["deleted_at"], d["coll_deleted_at"]) for k, d in row["deletions"].items()} == {"o": (4, 4)}
    assert D.decode(frame(spark, '{"pk":1,"__sys_clts":[3,8]}'), NOW).first()["latest_wt"] == 8
    assert D.decode(frame(spark, '{"pk":1,"__sys_rw_ts":9,"__sys_rw_ttl":[50,40]}'), NOW).first()["marker"]["expiry"] == 40


def test_texts_are_parsed_twice(spark):
    plan = D.decode(frame(spark, "{}"), NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("parse_json") <= 2  # the second only of rejected texts


def atoms(spark, *texts):
    return A.atoms(M.plan(D.decode(frame(spark, *texts).select("json", F.get_json_object("json", "$.pk").alias("pk"), F.get_json_object("json", "$.ck").alias("ck")), NOW), KINDS, CLASSES, NOW), ["pk", "ck"], CLASSES, ["ck"], ["st"])


def cells(log):
    return sorted([(r["column"], r["path"], r["value"], r["wt"]) for r in A.live(A.state(log, ["pk", "ck"]), 0).collect()], key=repr)


def test_parts_of_collections(spark):
    log = atoms(spark, '{"pk":"p","ck":"c","v":"1","s":[1,2],"m":{"a":"x","b":"y"},"u":{"hue":"red"},"st":"z","__sys_rw_ts":100,"__sys_clts":{"v":100,"s":[100,300],"m":[100,400],"u":{"hue":100},"st":100}}',
                '{"pk":"p","ck":"c","v":"2","__sys_rw_ts":200,"__sys_clts":{"v":200},"__sys_clts_tmbstn":{"s":[250,{"2":350}],"m":[99,{"a":90}]}}')
    # the set was cleared at 250 and its newer element removed at 350
    assert cells(log) == sorted([(None, None, None, 200), ("v", "", "2", 200), ("m", "a", "x", 100), ("m", "b", "y", 400), ("u", "hue", "red", 100), ("st", "", "z", 100)], key=repr)


def test_deleted_rows_stay_deleted(spark):
    old = '{"pk":"p","ck":"c","v":"1","s":[1],"st":"z","__sys_rw_ts":100,"__sys_clts":{"v":100,"s":[100],"st":100}}'
    gone = '{"pk":"p","ck":"c","__sys_rw_ts":null,"__sys_rw_tmbstn":150}'
    new = '{"pk":"p","ck":"c","v":"3","__sys_rw_ts":160,"__sys_clts":{"v":160}}'
    assert cells(atoms(spark, old, gone)) == [("st", "", "z", 100)]  # statics are the partition's
    assert cells(atoms(spark, new, gone, old)) == sorted([(None, None, None, 160), ("v", "", "3", 160), ("st", "", "z", 100)], key=repr)


def random_atoms(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        scope = r.choice(["cell"] * 6 + ["marker", "clear", "row"])
        column = r.choice("ab") if scope in ("cell", "clear") else None
        path = r.choice("xy") if scope == "cell" else None
        gone = scope in ("clear", "row") or scope == "cell" and r.random() < 0.2
        out.append((r.randint(0, 5), scope, column, path, None if gone or scope == "marker" else r.choice("pqr"), r.randint(1, 30), None if gone or r.random() < 0.6 else r.randint(1, 40), gone))
    return out


LOG = "k int, scope string, column string, path string, value string, wt bigint, expiry bigint, del boolean"


def plain_state(rows):
    out = []
    places = {}
    order = lambda a: (a[5], a[7], a[4] is not None, a[4] or "", a[6] is None, a[6] or 0)
    for a in rows:
        at = a[:4]
        places[at] = max(places.get(at, a), a, key=order)
    for (k, scope, column, path), a in places.items():
        if scope not in ("cell", "marker"):
            continue
        shadows = [b[5] for b in rows if b[0] == k and (b[1] == "row" or b[1] == "clear" and b[2] == column and scope == "cell")]
        if a[5] > max(shadows, default=-1):
            out.append((k, column, path, *a[4:]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_state_equals_brute_force_in_any_order(spark, seed):
    rows = random_atoms(seed, 120)
    df = spark.createDataFrame(rows, LOG).repartition(3)
    assert sorted(map(tuple, A.state(df, ["k"]).collect()), key=repr) == plain_state(rows)
    half = len(rows) // 2
    parts = [A.compact(spark.createDataFrame(p, LOG), ["k"]) for p in (rows[half:], rows[:half])]
    assert sorted(map(tuple, A.state(parts[0].union(parts[1]), ["k"]).collect()), key=repr) == plain_state(rows)


def test_collected_deletions_revive_nothing(spark):
    rows = random_atoms(9, 200)
    early, horizon = [a for a in rows if a[5] <= 20], 20
    base = A.compact(spark.createDataFrame(early, LOG), ["k"], horizon)
    assert base.where("del").isEmpty()
    on_time, late = A.late(spark.createDataFrame(rows, LOG), horizon)
    assert late.count() == len(early)
    dead = lambda state: [c for c in state if not c[-1]]
    assert dead(sorted(map(tuple, A.state(base.union(on_time), ["k"]).collect()), key=repr)) == dead(plain_state(rows))
    expired = spark.createDataFrame([(1, "cell", "a", "x", "v", 5, 1, False), (1, "cell", "a", "x", "u", 4, None, False)], LOG)
    assert A.compact(expired, ["k"], horizon=10_000_000, now=8).isEmpty()  # what expired does not bring back what it overwrote


def test_log_is_bounded_under_overwrites(spark, tmp_path):
    log, sizes = R.MutationLog(spark, str(tmp_path / "log")), []
    for batch in range(5):
        log.write(spark.createDataFrame([(k, "cell", "a", "x", str(batch), 10 * batch + 1, None, k % 3 == batch % 3) for k in range(30)], LOG), batch)
        log.rewrite(lambda a, batch=batch: A.compact(a, ["source", "k"], horizon=10 * batch - 5))
        sizes.append(log.read().count())
    assert max(sizes) == 30 and A.state(log.read(), ["source", "k"]).where("del").count() == 10


# the log
SCHEMA = "tbl string, pk long, wt long, seq long, val string, expiry long, del boolean"


def test_tables_of_one_log_keep_their_keys_apart(spark, tmp_path):
    log = R.MutationLog(spark, str(tmp_path / "log"))
    log.write(spark.createDataFrame([("a", 1, 10, 1, "x", None, False), ("007", 1, 20, 2, "y", None, False), (None, 1, 5, 3, "z", None, False)], SCHEMA), 0, "tbl")
    for _ in range(2):
        assert {(r["source"], r["val"]) for r in log.state(["pk"], ["seq"]).collect()} == {("a", "x"), ("007", "y"), (None, "z")}
        log.compact(["pk"], ["seq"])
    assert {(r["source"], r["tbl"], r["val"]) for r in log.read().collect()} == {("a", "a", "x"), ("007", "007", "y"), (None, None, "z")}


def test_readers_outlive_a_compaction(spark, tmp_path):
    log = R.MutationLog(spark, str(tmp_path / "log"))
    rows = lambda v, t: spark.createDataFrame([("a", k, t, k, v, None, False) for k in range(50)], SCHEMA)
    log.write(rows("old", 1), 0)
    log.write(rows("new", 2), 1)
    reader = log.read()  # began before
    version = log.manifest()["version"]
    log.compact(["pk"], ["seq"])
    assert log.read().count() == 50 and reader.count() == 100 and log.read(version).count() == 100
    log.write(rows("late", 0), 2)
    log.write(rows("again", 3), 2)  # a batch that runs again takes its own place
    assert {r["val"] for r in log.read().collect()} == {"new", "again"}


def test_position_outlives_purged_commits(spark, tmp_path):
    for n in (4, 5):
        (tmp_path / "commits").mkdir(exist_ok=True)
        (tmp_path / "commits" / str(n)).write_text("v1\n{}")
        (tmp_path / "commits" / f".{n}.crc").write_text("")
    assert R.position(spark, str(tmp_path)) == 6 and R.position(spark, str(tmp_path / "none")) == 0


def test_a_batch_is_derived_once(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as seq", "id % 4 as tbl")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    log = R.MutationLog(spark, str(tmp_path / "log"))
    R.replicate(R.tail(spark, str(tmp_path / "in"), rows.schema), log, str(tmp_path / "checkpoint"), lambda b: b.mapInArrow(count, rows.schema), reject="seq < 0", counters=R.Counters(str(tmp_path / "counters"), ["tbl"], "seq % 10 = 0")).awaitTermination()
    assert ran.value == 40 and log.read().count() == 40
    assert {(r["tbl"], r["replayed"], r["errors"]) for r in R.read_counters(spark, str(tmp_path / "counters"), ["tbl"]).collect()} == {(0, 10, 2), (1, 10, 0), (2, 10, 2), (3, 10, 0)}


# pages, probes, selections
def table_with_nulls(spark):
    r = random.Random(3)
    keys = {(None, None)} | {(r.choice([None, 1, 2, 3]), r.choice([None, *range(6)])) for _ in range(60)}
    return spark.createDataFrame(sorted(keys, key=repr), "a int, b int"), keys


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_pages_give_each_row_once(spark, size):
    df, keys = table_with_nulls(spark)
    df, seen, after = df.cache(), [], {"a": None, "b": None}
    while got := ranges.page(df, after, size).collect():
        seen += [(r["a"], r["b"]) for r in got]
        after = got[-1]["next"].asDict()
    assert len(seen) == len(keys) and set(seen) == keys
    order = lambda k: (k[0] is not None, k[0] or 0, k[1] is not None, k[1] or 0)
    assert seen == sorted(keys, key=order)


def test_page_index_has_each_row_once(spark):
    rows = [(r % 5 if r % 4 else None,) for r in range(500)]
    df = ranges.paged(spark.createDataFrame(rows, "a int").repartition(6), ["a"], 60, parts=5)
    got = [(r["rank"], r["page"], r["a"]) for r in df.orderBy("rank").collect()]
    assert [g[0] for g in got] == list(range(500)) and [g[1] for g in got] == [i // 60 for i in range(500)]
    assert [g[2] for g in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))


def test_ranges_are_balanced(spark):
    rows = spark.range(3000).selectExpr("if(id < 1500, 7, id) as k", "id")
    got = ranges.balanced(rows, ["k", "id"], 300, parts=4).collect()
    assert sum(r["rows"] for r in got) == 3000 and max(r["rows"] for r in got) <= 1.2 * 3000 / len(got)


def test_unknown_pages_are_not_done(spark):
    pages = spark.createDataFrame([(0, 1, True), (0, 2, None), (0, 3, True)], "r int, seq int, done boolean")
    assert ranges.safe_resume_point(pages, ["r"]).first()["next_seq"] == 2
    assert ranges.untrimmed(pages, ["r"]).count() == 2
    assert ranges.range_progress(pages.withColumn("t", F.lit(1)), ["t"], "r").first()["drained"] is False


def test_unreadable_files_count_as_data(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_bytes(b"not parquet at all")
    assert T.has_data(lambda: spark.read.parquet(str(tmp_path / "t")))
    assert T.has_data(lambda: spark.read.schema("a int").parquet(str(tmp_path / "t")))


def test_long_quoted_names(spark):
    name = 'x""' * 3000
    rows = K.parse_selection(spark.createDataFrame([(f'"{name}".t, "".t, "a""b"."c"',)], "selection string")).orderBy("pos").collect()
    assert [(r["keyspace"], r["tbl"], r["valid"]) for r in rows][0] == ('x"' * 3000, "t", True)
    assert [r["valid"] for r in rows] == [True, False, True] and rows[2]["keyspace"] == 'a"b'


# reconciliation
def test_tree_equals_full_comparison(spark):
    rows = [(k if k % 50 else None, k, f"v{k}") for k in range(1, 900)]
    other = [(a, b, v + "!" if b % 97 == 0 else v) for a, b, v in rows if b % 101] + [(5000, 1, "new"), (None, None, "new")]
    s, t = (spark.createDataFrame(x, "a int, b int, v string") for x in (rows, other))
    want = sorted(map(tuple, recon.recon_rows(s, t, ["a", "b"], ["v"]).where("state <> 'equal'").collect()), key=repr)
    for levels in (1, 2, 3):
        assert sorted(map(tuple, recon.recon_tree(s, t, ["a", "b"], ["v"], levels).collect()), key=repr) == want
    assert recon.recon_tree(s, s, ["a", "b"], ["v"]).isEmpty() and len(want) > 15


def test_null_keys_match_in_every_comparison(spark):
    s = spark.createDataFrame([(None, 5, [1, 2]), (2, None, [1])], "k int, expiry int, l array<int>")
    t = spark.createDataFrame([(None, 9, [2, 1]), (3, 1, [1])], s.schema)
    assert [(r["k"], r["ttl_ok"]) for r in recon.recon_ttl(s, t, ["k"], 2).collect()] == [(None, False)]
    assert sorted(((r["k"], r["ttl_ok"]) for r in recon.recon_ttl(s, t, ["k"], 4, True).collect()), key=repr) == [(2, False), (3, False), (None, True)]
    assert [(r["k"], r["differs"]) for r in recon.recon_collections(s, t, ["k"], "l").collect()] == [(None, False)]
    assert sorted((r["k"], r["side"]) for r in recon.recon_elements(s, t, ["k"], "l").collect()) == [(2, "source"), (3, "target")]
    assert [(r["k"], r["same"]) for r in recon.spot_check(s, t, ["k"], F.lit(True), ["expiry"]).collect()] == [(None, False)]
    assert sorted(r["k"] for r in recon.recon_static(s.where("k = 2"), t.where("k = 3"), ["k"], "l").collect()) == [2, 3]


# scans
@pytest.mark.parametrize("span", [3, 50, 10_000])
def test_scans_equal_brute_force(spark, span):
    r = random.Random(span)
    rows = [(k, o, r.choice([None, 1, 2, 5])) for k in ("a", "b", None) for o in r.sample(range(-200, 400), 150)] + [("a", None, 4)]
    got = S.scan(spark.createDataFrame(rows, "k string, o long, v long").repartition(4), ["k"], "o", {"run": F.col("v")}, {"newest": F.col("v")}, {"before": F.col("v")}, {"first": F.col("v")}, span)
    want = []
    for k in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0))
        total, newest, before = None, None, None
        for _, o, v in own:
            total = total if v is None else (total or 0) + v
            newest = newest if v is None else v
            want.append((k, o, v, total, newest, before, own[0][2]))
            before = v
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_one_key_is_scanned_by_many_tasks(spark):
    df = S.scan(spark.range(4000).selectExpr("'x' as k", "id as o"), ["k"], "o", {"run": F.lit(1)}, span=100)
    parts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= 3 and df.agg(F.max("run")).first()[0] == 4000


def test_streamed_envelopes_equal_the_batch(spark):
    stream = Q.Q["stream_envelopes"](spark, "/root/testdata/sf0.001")
    batch = Q.Q["apply_mutations"](spark, "/root/testdata/sf0.001")
    assert stream.count() == batch.count() > 0 and stream.exceptAll(batch).isEmpty()
    assert json.loads(Q.Q["apply_live_rows"](spark, "/root/testdata/sf0.001").where("hist is not null").first()["hist"])


def test_state_in_the_stream_equals_the_log(spark, tmp_path):
    from driftline.streaming import keyed as Y

    far = 4_102_444_800
    rows = [(*a[:6], None if a[6] is None else a[6] if a[6] < 20 else far + a[6], a[7]) for a in random_atoms(17, 150)]
    for part in range(3):  # each run takes the state up where the last one left it
        spark.createDataFrame(rows[part::3], LOG).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = R.tail(spark, str(tmp_path / "in"), spark.createDataFrame([], LOG).schema)
        Y.keep(Y.changes(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    # places may have expired before a later run brought an older atom
    want = sorted((c[:6] for c in plain_state(rows) if not c[6] and (c[5] is None or c[5] > 2_000_000_000)), key=repr)
    got = Y.target(spark, str(tmp_path / "out"), ["k"]).collect()
    assert sorted(map(tuple, got), key=repr) == want and want
