"""Every core query runs on the smallest tables and, where it has SQL, gives what the SQL gives."""

import importlib

import pytest

from conftest import same_as_oracle

MODULES = [importlib.import_module(f"rankspark.plans.{m}") for m in ("fields", "texts", "search", "evaluate", "report", "lifecycle")]
ALL = {k: (v, m.ORACLES.get(k)) for m in MODULES for k, v in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, small, name):
    query, sql = ALL[name]
    if sql is None:
        frame = query(spark, small)
        assert frame.columns and frame.count() >= 0
    else:
        same_as_oracle(spark, small, query, sql)
