"""Every query runs on the smallest tables, and agrees with its SQL where it has any."""

import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")

from tilewright.queries import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{p}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    got = df.collect()
    if name in oracle_sql():
        cur = db.execute(oracle_sql()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, cur.fetchall())
    else:
        assert got
