"""Every core query: against its SQL on small dirty tables, on empty ones, and with clashing columns."""

from __future__ import annotations

import pytest

from marlinspike import queries, queries_data, sql, sql_data
from tests.oracle import same

QUERIES = queries.QUERIES | queries_data.QUERIES
SQL = sql.SQL | sql_data.SQL
#: Their SQL form says nothing on rows without a key, which the operators leave out.
NULL_KEYS = {"missing_vectors", "text_functions", "totals", "out_degrees", "p4_found", "p4_report", "verdict_carry", "link_resolution", "finding_triage", "islands", "reading_batches", "broken_links", "link_demand", "coverage_mass", "lane_fusion", "bm25_top", "stale_signs", "fresh_gotchas", "duplicate_chunks", "session_facts", "role_totals"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, tables["full"])
    rows = df.collect()
    if name in SQL and name not in NULL_KEYS:
        same(df.columns, rows, SQL[name], tables["full"])
    wide = QUERIES[name](spark, tables["wide"])
    assert wide.columns == df.columns
    assert wide.count() == len(rows)
    if name not in ("lane_fusion", "knn_cosine"):  # they ask for a row to start from
        assert QUERIES[name](spark, tables["empty"]).count() <= 12


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
