"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from cohortspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_every_operator_has_a_query():
    assert [n for k in range(1, 14) for n in queries.QUERIES if n.startswith(f"op{k}_")] == list(queries.QUERIES)
