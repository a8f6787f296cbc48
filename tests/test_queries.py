"""Every query of the graph engine against its SQL on an independent engine."""

from __future__ import annotations

import pytest
from conftest import rows_of, rows_of_sql

from weftgraph import queries
from weftgraph.queries import ORACLES, QUERIES


SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    rows = rows_of(got)
    assert rows, "empty against empty proves nothing"
    if name in ORACLES:
        columns, want = rows_of_sql(ORACLES[name], SF_DIR)
        assert sorted(got.columns) == columns
        assert rows == want


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        queries.on_tables("symbol", lambda spark, d: None)


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
