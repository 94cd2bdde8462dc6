import itertools

import pytest
from pyspark.sql import functions as F

from clearsift.functions.access import masked_query, visible
from clearsift.operators import audits
from clearsift.operators import entitlements as E

DEPTS = [None, [], ["HR"], ["HR", "Dev"], ["HR", "HR"], ["d:HR", "*"]]
PEOPLE = [(d, c) for d in ("HR", "Dev", "*", "d:HR") for c in (1, 2, 3)]


def may_see(required, allowed, department, clearance):
    return required <= clearance and (not allowed or department in allowed)


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, rc, d) for i, (rc, d) in enumerate(itertools.product((1, 2, 3), DEPTS))]
    documents = spark.createDataFrame(
        docs, "document_id long, required_clearance int, allowed_departments array<string>"
    )
    people = spark.createDataFrame(
        [(f"{d}{c}", d, c, "member") for d, c in PEOPLE],
        "name string, department string, clearance int, role string",
    )
    return docs, documents, people


def test_predicate_and_join_forms(spark, tables):
    docs, documents, people = tables
    expected = {(i, f"{d}{c}") for i, rc, a in docs for d, c in PEOPLE if may_see(rc, a, d, c)}
    joined = E.visible_documents(documents, people)
    assert {(r.document_id, r.name) for r in joined.collect()} == expected
    assert joined.count() == len(expected)
    assert audits.rule_disagreements(documents, people).isEmpty()
    by_class = E.principal_classes(people)
    pairs = audits.predicate_pairs(documents, by_class)
    assert pairs.count() == len(expected)


def test_join_form_has_no_nested_loop(spark, tables):
    _, documents, people = tables
    plan = E.class_sets(documents, E.principal_classes(people))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unknown_principal_sees_nothing(spark, tables):
    _, documents, _ = tables
    nobody = documents.where(visible("required_clearance", "allowed_departments", F.lit(None), F.lit(None)))
    assert nobody.isEmpty()


def test_document_counts_include_zero(spark, tables):
    docs, documents, people = tables
    secret = documents.where("required_clearance = 3")
    counts = dict(E.visible_document_counts(secret, people).collect())
    assert counts["HR1"] == 0 and counts["HR3"] == 5


def test_personas_resolve_or_are_rejected(spark, tables):
    _, _, people = tables
    asked = spark.createDataFrame([(1, "HR1"), (2, "ghost")], "request_id long, persona string")
    known, rejected = E.resolve_personas(asked, people)
    assert [r.request_id for r in known.collect()] == [1]
    with pytest.raises(E.UnknownPersona) as failure:
        E.require_known(rejected)
    assert "HR1" not in str(failure.value) and "ghost" not in str(failure.value)


def hits(spark, clearance):
    return spark.createDataFrame(
        [(1, 7, 2, None, clearance, "HR", "secret text"), (1, 8, 1, ["Dev"], 3, "HR", "other")],
        "request_id long, chunk_id long, required_clearance int, allowed_departments array<string>,"
        " clearance int, department string, text string",
    )


@pytest.mark.parametrize("clearance,ids", [(1, {7, 8}), (2, {8}), (None, {7, 8})])
def test_enforce_raises_with_ids_only(spark, clearance, ids):
    with pytest.raises(E.AccessViolation) as failure:
        E.enforce(hits(spark, clearance))
    named = {r.resource_id for r in failure.value.rows.collect()}
    assert failure.value.kind == "chunk" and named == ids == set(named) and failure.value.count
    assert "secret" not in str(failure.value)


def test_enforce_returns_clean_hits_unchanged(spark):
    clean = hits(spark, 2).where("chunk_id = 7")
    assert E.enforce(clean) is clean


def test_hydrate_drops_out_of_scope_and_keeps_order(spark):
    chunks = spark.createDataFrame(
        [(1, 10, 5, "a"), (2, 10, None, "b"), (3, 20, None, "c")],
        "chunk_id long, document_id long, clause_id long, text string",
    )
    documents = spark.createDataFrame(
        [(10, "open", 1, None), (20, "closed", 3, None)],
        "document_id long, title string, required_clearance int, allowed_departments array<string>",
    )
    clauses = spark.createDataFrame([(5, "1.1.1")], "clause_id long, code string")
    ranked = spark.createDataFrame(
        [(9, 1, 3, "HR", 1), (9, 2, 2, "HR", 1), (9, 3, 1, "HR", 1)],
        "request_id long, rank int, chunk_id long, department string, clearance int",
    )
    rows = E.hydrate(ranked, chunks, documents, clauses).orderBy("rank").collect()
    assert [(r.rank, r.chunk_id, r.clause_code, r.allowed_departments) for r in rows] == [
        (2, 2, None, []),
        (3, 1, "1.1.1", []),
    ]
    codes = E.clause_codes(ranked, chunks, documents, clauses).orderBy("rank").collect()
    assert [r.clause_code for r in codes] == ["조항 밖", "1.1.1"]


@pytest.mark.parametrize(
    "row,mine,shown", [("a", "a", True), ("a", "b", False), (None, None, False), ("", "", False), (None, "a", False)]
)
def test_masking(spark, row, mine, shown):
    df = spark.createDataFrame([("q", row)], "q string, s string")
    got = df.select(masked_query("q", F.col("s"), F.lit(mine).cast("string")).alias("r")).head().r
    assert (got == "q") is shown
