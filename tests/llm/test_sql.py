"""Queries of the subpackage beside their SQL on the small tables."""
import pytest

from check_sql import compare, connect
from logweir.llm.queries import CHECKS


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, sf_dir) in (None, "empty")
