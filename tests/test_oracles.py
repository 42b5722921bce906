"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import oracle  # noqa: E402

from tessera import registry  # noqa: E402

SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.exists(oracle.SF), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark):
    oracle.agree(registry.queries()[name], SQL[name], spark)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(name, spark):
    assert registry.queries()[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    assert registry.entry(spark, oracle.SF).count() > 0
