"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
import compare


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lang", "n_posts"}


def test_sql_has_no_orphans():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, small, name):
    ok, note = compare.compare(spark, con, small, name)
    assert ok, note
    assert "types" not in note
