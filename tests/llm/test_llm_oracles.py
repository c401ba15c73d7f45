"""The queries of the training-data operators against their SQL, on the smallest tables."""

import pytest

from rulestream.llm.queries import ORACLES, QUERIES


def test_there_is_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])
