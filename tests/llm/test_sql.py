"""Queries of the pipeline's operators against their SQL."""

import os

import duckdb
import pytest

from readweft.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall(), key=repr)


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
