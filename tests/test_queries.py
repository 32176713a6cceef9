"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from panelforge.plans import catalog
from tools.check_sql import compare, connect

# Fitted models are tested in test_models; here they would only repeat that at length.
COMPARED = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"tier_model_metrics", "walk_forward_search", "next_day_forecast"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 12


@pytest.mark.parametrize("name", COMPARED)
def test_query_agrees_with_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF, name)
    assert ok, note
