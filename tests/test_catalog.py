"""Every registered query runs; those with SQL agree with it on whole tables."""

import sys
from pathlib import Path

import pytest
from oracle import difference

sys.path.insert(0, str(Path(__file__).parents[1]))
from loomsift.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert difference(catalog.QUERIES[name](spark, sf), catalog.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "text", "source_file", "source_uri", "task_type"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
