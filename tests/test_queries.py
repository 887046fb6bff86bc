"""Every registered query equals its DuckDB statement on the smallest tables."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as registered  # noqa: E402
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_query_has_a_statement():
    without = set(registered.queries()) - set(registered.oracle_sql())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in without)


@pytest.mark.parametrize("name", registered.oracle_sql())
def test_query(spark, duck, name):
    assert compare.difference(spark, SF, name, duck) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0
