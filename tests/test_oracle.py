"""Registered queries next to their SQL on the smallest tables.

Small ranges are not put together here, so groups are cut into chunks.
"""

import pytest
from compare import compare, load

import __spark_entry__ as entry
from usetrail.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return load(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        ok, note = compare(spark, con, name, QUERIES[name], CHECKS.get(name), SF)
    finally:
        spark.conf.unset(setting)
    assert ok, note


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
