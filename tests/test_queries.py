"""Every registered query runs; those with SQL agree with DuckDB."""

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_entry_answers_the_flagship_question(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["method"] == "kruskal" and rows[0]["p_value"] < 0.05


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, data, name):
    sql = entry.oracle_sql().get(name)
    status, note, _ = compare(spark, duck, name, entry.queries()[name], sql, data)
    assert status == ("OK" if sql else "ROWS"), f"{status}: {note}"
