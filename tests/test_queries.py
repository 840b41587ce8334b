"""Registered queries against DuckDB on the smallest tables; ALL_QUERIES=1 runs every one of them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare, connect
from tallyferry import workload

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "export_flagship", "filter_nested_groups", "join_three_relations", "sort_asc_nulls", "page_offset_only",
    "validate_error_order", "merge_actions", "merge_hot_keys", "history_last_run", "rate_hot_key", "csv_row_numbers",
    "stream_rate_window",
)
QUERIES = workload.QUERIES
NAMES = list(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, _, note = compare(spark, con, SF_DIR, QUERIES[name], entry_module.oracle_sql().get(name))
    assert ok, note


def test_every_query_has_an_oracle():
    assert set(workload.ORACLES) == set(workload.QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
