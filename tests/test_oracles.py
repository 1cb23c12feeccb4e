"""Every registered query of the reference's kind against its SQL."""

from __future__ import annotations

import pytest

from caseloom.plans import catalog
from tests.conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    same_as_sql(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
