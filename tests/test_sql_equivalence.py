"""Every library query with an SQL equivalent gives the same rows."""

from __future__ import annotations

import pytest

from codexloom.plans import registry
from tests.compare import SF, by_sql, rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), by_sql(registry.ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
