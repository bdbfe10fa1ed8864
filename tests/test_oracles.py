"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import compare
import pytest

import __spark_entry__ as entry

CHECKED = sorted(entry.oracle_sql())
OTHERS = sorted(set(entry.queries()) - set(CHECKED))


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_rows_are_those_of_sql(spark, con, sf_dir, name):
    assert not compare.differences(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", OTHERS)
def test_runs(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
