"""Access records of hits and violations, and the columns they carry."""

import pytest

import __spark_entry__ as entry
from clearsift.operators import access_log
from clearsift.schema import RECORD_COLUMNS
from test_registered import FOLDER, duck, rows_of  # noqa: F401

REQUEST = "request_id long, ts timestamp, persona string, department string, clearance int, query string, session_id string"


@pytest.mark.parametrize("name", ["hit_records", "violation_records", "exposed_columns"])
def test_matches_sql(spark, duck, name):  # noqa: F811
    result = entry.queries()[name](spark, FOLDER)
    relation = duck.sql(entry.oracle_sql()[name])
    expected = rows_of(relation.fetchall(), relation.columns)
    assert rows_of([tuple(r) for r in result.collect()], result.columns) == expected


def test_records_have_the_stored_columns(spark):
    requests = spark.createDataFrame([(1, None, "p", "d", 1, "q", None)], REQUEST)
    hits = spark.createDataFrame([(1, "1.1.1", 7)], "request_id long, clause_code string, chunk_id long")
    found = spark.createDataFrame([(1, "chunk", 8)], "request_id long, resource_kind string, resource_id long")
    allowed = access_log.hit_records(hits, requests)
    refused = access_log.violation_records(found, requests)
    assert allowed.columns == refused.columns == RECORD_COLUMNS
    assert [(r.resource_id, r.allowed) for r in allowed.unionByName(refused).collect()] == [(7, True), (8, False)]
