"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from rulestream.plans.oracles import ORACLES
from rulestream.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])
