"""Every query of the read operators against its SQL."""

import os

import duckdb
import pytest

from readweft.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    return c


def _plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert rows == sorted((tuple(map(_plain, r)) for r in found), key=repr)
