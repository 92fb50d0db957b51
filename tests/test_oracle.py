"""Every registered query against its SQL check, on the smallest supplied tables."""

import pytest

from invq.plans import registry
from tests.checker import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    problem, n = compare(spark, con, name, registry.QUERIES[name], registry.ORACLES.get(name), SF)
    assert problem is None
    assert n > 0


def test_every_query_has_a_check():
    assert set(registry.ORACLES) == set(registry.QUERIES)
