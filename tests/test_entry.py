"""Every registered query runs and equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

from checkframe import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_queries_equal_their_sql(spark, db):
    queries, oracle = core.queries(), core.oracle_sql()
    assert set(oracle) <= set(queries)
    wrong = []
    for name, sql in oracle.items():
        got = queries[name](spark, DIR)
        columns = sorted(got.columns)
        want = db.sql(sql)
        ours = sorted(repr([r[c] for c in columns]) for r in got.collect())
        theirs = sorted(repr([dict(zip(want.columns, r, strict=True))[c] for c in columns]) for r in want.fetchall())
        if ours != theirs:
            wrong.append(name)
    assert wrong == []


def test_entry_imports():
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
