"""Every query that has SQL agrees with it on the smallest tables."""

import math

import duckdb
import pytest

from glyphmill.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    a = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(str([plain(dict(zip(want.columns, r))[c]) for c in columns]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
