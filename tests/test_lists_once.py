"""What a search's hits say is worked out once a search, and lists of requests
are not shuffled or sorted in parts that grow."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clearsift.operators import audits, logs, retrieval
from clearsift.plans import corpus, search_queries
from test_registered import FOLDER, duck, rows_of  # noqa: F401


@pytest.mark.parametrize(
    "name",
    ["hydrate_hits", "fold_by_clause", "clause_codes", "record_blocks", "planted_order_conflicts", "load_logs", "load_report"],
)
def test_matches_sql(spark, duck, name):  # noqa: F811
    result = entry.queries()[name](spark, FOLDER)
    relation = duck.sql(entry.oracle_sql()[name])
    expected = rows_of(relation.fetchall(), relation.columns)
    assert rows_of([tuple(r) for r in result.collect()], result.columns) == expected


def _listed(spark):
    events = corpus.log_events(spark, FOLDER)
    hosts = corpus.hosts(spark, FOLDER)
    requests, _ = logs.valid_since(corpus.log_requests(spark, FOLDER))
    return events, hosts, requests


def test_listed_blocks_equal_collected_ones(spark):
    flat = retrieval.record_blocks(logs.query_logs(*_listed(spark)), _listed(spark)[2])
    lists = logs.query_log_lists(*_listed(spark), retrieval.record_entry().alias("entry"))
    listed = retrieval.listed_blocks(lists)
    assert listed.count() == flat.count()
    assert listed.exceptAll(flat.select("request_id", "block")).isEmpty()


def test_first_request_stands_for_its_search(spark):
    rows = [(5, 1, "a", "HR"), (3, 1, "a", "HR"), (4, 1, "b", "IT"), (9, 2, "a", "HR")]
    requests = spark.createDataFrame(rows, "request_id long, query_id long, class_key string, department string")
    first = search_queries._one_each(requests)
    assert sorted(r.request_id for r in first.collect()) == [3, 4, 9]
    given = search_queries._handed_back(first.select("request_id", F.lit(7).alias("n")), first, requests)
    assert sorted(tuple(r) for r in given.collect()) == [(3, 7), (4, 7), (5, 7), (9, 7)]


def test_lists_are_sorted_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(audits, "SORTED_ROWS", 10, raising=False)
    hits = spark.range(1000).select(
        (F.col("id") / 5).cast("long").alias("request_id"), (F.col("id") % 5).alias("rank"),
        F.lit(1).alias("query_id"), F.col("id").alias("chunk_id"), F.col("id").cast("double").alias("distance"),
    )
    found = audits.order_conflicts(hits)
    assert found.collect()[0][:3] == (1, 0, 1000)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
