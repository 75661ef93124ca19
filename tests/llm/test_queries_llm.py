"""The registered queries against SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from driftline.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(Q.ORACLES[name])
    names = [c[0] for c in out.description]
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted(map(repr, rows))
    assert key([tuple(r[c] for c in names) for r in df.collect()]) == key(out.fetchall())


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows, checked by what it must keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language ID"](spark, docs, SF)
    kept, letters = {r["doc_id"] for r in known.collect()}, {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
    assert known.columns == docs.columns and kept <= letters and {i for i in letters if before[i]["lang"]} <= kept
    from driftline.llm.common import save
    from driftline.llm.ngram_join import similar_classes

    one = save(stages["n-gram Jaccard join"](spark, known, SF), "t")
    assert {r["doc_id"] for r in one.collect()} == {r["class_id"] for r in similar_classes(known).collect()}
    from driftline.llm.decontaminate import annotate

    clean = save(stages["benchmark decontamination"](spark, one, SF), "t")
    dirty = {r["doc_id"] for r in annotate(one, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - dirty
    mixed = save(stages["mixing sources to target weights"](spark, clean, SF), "t")
    assert mixed.columns == docs.columns
    sharded = stages["sharding"](spark, mixed, SF).collect()
    assert len(sharded) == mixed.count() and {r["shard"] for r in sharded} <= set(range(8))
