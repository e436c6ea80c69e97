"""Every query of the library against its SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pytest

from loomspark import registry

TABLES = "/root/testdata/sf0.01"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()
FREE = [n for n in registry.queries() if n not in SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        path = f"{TABLES}/{n}.parquet"
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, TABLES)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    run = duck.execute(SQL[name])
    assert got == rows([c[0] for c in run.description], run.fetchall())


@pytest.mark.parametrize("name", FREE)
def test_query_repeats(spark, name):
    query = registry.queries()[name]
    first = query(spark, "/root/testdata/sf0.001")
    assert first.columns and sorted(map(repr, first.collect())) == sorted(map(repr, query(spark, "/root/testdata/sf0.001").collect()))
