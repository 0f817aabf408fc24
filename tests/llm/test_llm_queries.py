"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import pytest

from conftest import same_as_oracle
from rankspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    if name in queries.ORACLES:
        same_as_oracle(spark, small, queries.QUERIES[name], queries.ORACLES[name])
    else:
        frame = queries.QUERIES[name](spark, small)
        assert frame.columns and frame.count() >= 0
