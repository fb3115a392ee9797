"""Every registered query that has SQL, held against it over the whole tables."""

from __future__ import annotations

import pytest

from foldframe.plans import files, reports  # noqa: F401  add their queries
from foldframe.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, agree):
    agree(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
