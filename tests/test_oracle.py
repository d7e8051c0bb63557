"""Every registered query against its SQL on the smallest tables."""

import pytest

from harvestry.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect

# nothing in the smallest tables qualifies for these reports
MAY_BE_EMPTY = {"work_stale_leases", "best_endpoints", "endpoint_list"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    diff, _, _ = compare(spark, con, sf_dir, name, QUERIES[name], ORACLE.get(name))
    assert diff is None or (diff == "no rows" and name in MAY_BE_EMPTY), diff


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
