"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check import normal

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    frame = entry_points.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in frame.collect()]
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    assert normal(frame.columns, rows) == normal([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
