"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry


def test_every_query_has_its_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_flagship_query(spark):
    result = entry.entry(spark)
    assert result.columns == ["project_id", "sha", "path", "insertions", "deletions", "aggregate", "pastchanges"]
    assert result.count() == result.select("project_id", "sha", "path").distinct().count() > 0
