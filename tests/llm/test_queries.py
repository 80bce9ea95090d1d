"""The queries of the training-data operators against their SQL on the smallest tables."""

import math
import os

import pytest

from scenewright.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(str([plain(r[c]) for c in names]) for r in df.collect()) == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
