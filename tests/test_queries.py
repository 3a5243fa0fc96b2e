"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from spanloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    want = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    b = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
    assert a == b
