from __future__ import annotations

import pytest

from quarry.plans import language_queries as q
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_matches_sql(spark, small, name):
    check(spark, small, q.QUERIES[name], q.ORACLES[name])
