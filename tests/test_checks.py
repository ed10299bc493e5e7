"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.verify import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, duck, key):
    status, note, _ = compare(spark, duck, key, entry.queries()[key], entry.oracle_sql().get(key), FOLDER)
    assert status in ("ok", "rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_wide_pairs_are_all_compared(spark, duck):
    columns = [f"w{k}" for k in range(44)]
    wanted = {(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]}
    found = [(r.column1, r.column2) for r in entry.queries()["corr_wide_pairs"](spark, FOLDER).collect()]
    assert set(found) == wanted and len(found) == 946
    assert set(duck.sql(f"SELECT column1, column2 FROM ({entry.oracle_sql()['corr_wide_pairs']})").fetchall()) == wanted


def test_kendall_of_several_columns(spark):
    found = [(r.column1, r.column2) for r in entry.queries()["corr_kendall_columns"](spark, FOLDER).collect()]
    assert len(set(found)) == len(found) == 6
