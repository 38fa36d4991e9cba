import os

import pytest

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 47


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() == 20 and out.columns[0] == "file"
