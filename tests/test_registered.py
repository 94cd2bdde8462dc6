"""Registered queries against their SQL over the smallest data set.

CLEARSIFT_ALL=1 compares every query, the default a spread of them.
"""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("CLEARSIFT_DATA", "/root/testdata/sf0.001")
SPREAD = [
    "vector_topk",
    "vector_topk_many",
    "stream_restart",
    "hybrid_search",
    "compare_paths",
    "session_evidence",
    "order_conflicts",
    "rule_agreements",
    "query_logs",
    "load_report",
    "daily_quota",
    "stream_log_load",
    "evaluate_golden",
    "citations",
    "dashboard_latest",
    "catalogue",
    "front_matter",
    "paged_clauses",
    "chunk_documents",
    "upsert_documents",
    "ingest_documents",
]
NAMES = sorted(entry.queries()) if os.environ.get("CLEARSIFT_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == sorted(relation.columns)
    expected = rows_of(relation.fetchall(), relation.columns)
    assert rows_of([tuple(r) for r in result.collect()], result.columns) == expected
