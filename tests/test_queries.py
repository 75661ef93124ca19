"""Every registered query runs; those with SQL equal DuckDB's result."""

import math
from collections import Counter

import duckdb
import pytest

from driftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if name not in registry.ORACLES:
        return
    out = db.execute(registry.ORACLES[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in out.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want
