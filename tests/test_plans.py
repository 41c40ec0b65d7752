"""Registered queries: names, SQL beside them, and plans that push filters and columns down to the scan."""

import os

import pytest

import __spark_entry__ as entry_module
from glyphmill.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.filter_metadata(spark, DATA))
    assert "PushedFilters: [" in text and "EqualTo(has_examples,1)" in text and "In(namespace" in text
    assert "raw_description" not in text.split("ReadSchema:")[1]
    assert "Exchange" not in text


def test_lint_has_no_shuffle(spark):
    from glyphmill.plans import code

    assert "Exchange" not in plan(code.lint_code(spark, DATA))


@pytest.mark.parametrize("name", sorted(n for m in entry_module._MODULES if "llm" not in m.__name__ for n in m.QUERIES))
def test_query_runs_on_the_smallest_tables(spark, name):
    df = entry_module.queries()[name](spark, DATA)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
