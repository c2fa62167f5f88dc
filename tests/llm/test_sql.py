"""The queries that have SQL agree with it on the smallest tables."""

import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")

from tilewright.llm.queries import oracle_sql, queries  # noqa: E402


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{p}')")
    df = queries()[name](spark, FOLDER)
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())
