"""Every named query against its SQL twin, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from adperf.entrypoints import queries as named
from adperf.entrypoints import twins
from tests.comparing import differences, duck

QUERIES = named.queries()
TWINS = twins.oracle_sql()
ROWS_ONLY = {"gbt_scored", "hpo_leaderboard", "feature_importance", "retrain_summary", "dq_registry"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_twin_but_the_trained_models():
    assert set(QUERIES) - set(TWINS) == ROWS_ONLY
    assert not set(TWINS) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, TWINS[name]) is None


def test_the_driver_sees_every_query():
    assert set(QUERIES) <= set(driver.queries())
    assert set(TWINS) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0
