"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lodestone import queries


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for name in os.listdir(folder):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    told = duck.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(told.columns)
    want = sorted((tuple(map(_plain, r)) for r in told.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert got == want
