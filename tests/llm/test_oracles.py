"""Registered queries of the corpus operators equal their SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
from checkframe.llm import registry  # noqa: E402

DIR = "/root/testdata/sf0.001"


def listed(frame, columns):
    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return int(x) if isinstance(x, float) and x == int(x) else x

    return sorted(repr([plain(x) for x in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    got = registry.queries()[name](spark, DIR).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert listed(got, columns) == listed(want, columns)
