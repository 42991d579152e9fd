from __future__ import annotations

import pytest

from quillon.llm.queries import ORACLES, QUERIES
from tests import oracle


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    oracle.check(spark, folder, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
