"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from harmattan.plans.registry import QUERIES
from tests.conftest import SF_DIR
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


#: Queries that SQL cannot express; each has a test of its own (test_limits.py, tests/llm).
WITHOUT_SQL = {"outlier_forest", "outlier_explanations"}


def test_every_other_query_has_sql():
    assert {n for n in QUERIES if n not in entry.oracle_sql()} == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name)
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "annee", "value", "is_total_row", "is_total_column"]
    assert df.count() > 0
