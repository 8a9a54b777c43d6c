"""Every registered cube query against its SQL."""

import pytest

from lumenfold.queries import ORACLES, QUERIES
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 35 and {r["Market"] for r in rows} == {"AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
