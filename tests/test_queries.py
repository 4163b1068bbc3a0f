"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from docfiling.plans import oracles, queries

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert name in SQL or got
    if name in SQL:
        found = db.execute(SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, found.fetchall())
