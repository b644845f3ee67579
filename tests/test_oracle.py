"""Every registered query with an oracle matches DuckDB on the small fixture
(the same comparison the correctness gate runs at sf0.01)."""

import pytest

from spanrisk.plans.catalog import load_all
from tests.conftest import SF_SMALL
from tests.harness import compare

REG = load_all()
WITH_SQL = sorted(n for n, e in REG.items() if e.sql is not None)


def test_registry_covers_survey():
    assert len(REG) >= 123
    assert not [n for n, e in REG.items() if e.sql is None]


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, duck_small, name):
    e = REG[name]
    ok, msg = compare(spark, duck_small, name, e.fn, e.sql, SF_SMALL)
    assert ok, f"{name}: {msg}"
