"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from oracle import compare, connect
from peakloom.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(REGISTRY))
def test_query(spark, con, key):
    problem, _ = compare(spark, con, key, REGISTRY[key], SF)
    assert not problem


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
