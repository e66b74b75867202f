"""Every registered query against its SQL twin at the smallest scale."""

import compare
import pytest

from canopygrid.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert compare.compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf) is None


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).limit(1).count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
