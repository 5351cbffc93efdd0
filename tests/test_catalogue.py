"""Every reference query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings".split()


def plain(rows):
    key = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(key(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, DATA)
    assert sorted(want.columns) == sorted(got.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())
