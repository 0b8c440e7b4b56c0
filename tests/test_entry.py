"""The driver's contract, and every check query against its SQL on the smallest tables."""

import os

import pytest

from checks import registered
from checks.run import compare, database

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLE = registered()

needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@needs_data
def test_entry_returns_prepared_reviews(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def connection():
    return database(SMALL)


# the slow composed jobs run in ``python -m checks.run``; their parts are tested on their own
SLOW = {n for n in QUERIES if n.startswith(("job3", "job4", "str1", "str4", "str5", "snk2", "str3_gate", "str3_cooldown_gate_split", "str3_cooldown_gate_burst"))}


@needs_data
@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_query_equals_its_sql(spark, connection, name):
    assert compare(spark, connection, name, SMALL, QUERIES, ORACLE).startswith("ok")
