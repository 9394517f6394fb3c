"""Every registered query runs; those with SQL give the rows that DuckDB gives on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from screenlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
    if name not in catalog.ORACLE:
        assert got
        return
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))
