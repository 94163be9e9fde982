"""Every query of the library against its SQL in DuckDB: columns, rows and values, in no order."""

import datetime
import decimal
import math

import duckdb
import pytest

from cohortspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int | float | decimal.Decimal):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


#: Minutes of training each, without SQL to compare with: test_whole_parameters.py holds their parameters and a small search.
TREES = {"train_trees", "train_trees_cv"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - TREES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert df.columns
        return
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, want.fetchall())
    got = rows(df.columns, got)
    assert len(got) == len(want)
    assert got == want
