"""Every registered query against its DuckDB statement, on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = sorted(entry.oracle_sql())
UNCHECKED = sorted(set(entry.queries()) - set(CHECKED))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, con, name):
    same, note = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert same, note
    assert not note.startswith("0 rows"), "nothing was compared"


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
