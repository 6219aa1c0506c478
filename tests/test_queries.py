"""Every registered query against its SQL, on the smallest supplied tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corepart.checks import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else repr(x) for x in r) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = normal(df.select(*cols).collect())
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == normal(tuple(r[i] for i in at) for r in res.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.part for r in rows} == {1, 2, 3, 4} and all(r.n_edges > 0 for r in rows)
