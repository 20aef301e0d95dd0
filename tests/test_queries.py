"""Each query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.plans import catalogue


def cell(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, data, db, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    found = db.sql(catalogue.SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
