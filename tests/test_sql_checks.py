"""Every query beside its SQL on the small tables."""
import pytest

from check_sql import compare, connect
from logweir.plans.catalog import QUERIES
from logweir.plans.checks import CHECKS


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) in (None, "empty")
