"""The contract: every query has rows or agrees with its SQL; the flagship query runs."""

from __future__ import annotations

import os

import pytest
from compare import difference, duck
from conftest import SMALL

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()
# Model fits, and catalogues that write many run folders, take minutes together.
SLOW = {n for n, q in QUERIES.items() if q.__module__.endswith("modelling")} | {
    "comparison_matrix", "inventory", "run_scan", "prepared_files", "feature_files"}
CHOSEN = sorted(QUERIES if os.environ.get("ALL_QUERIES") else set(QUERIES) - SLOW)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, connection, name):
    result = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert difference(result, connection, SQL[name]) == ""
    else:
        assert result.count() > 0
