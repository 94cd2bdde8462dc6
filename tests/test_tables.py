import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearsift import schema
from clearsift.operators import access_log, embedding
from clearsift.plans.ingest import ingest, ingest_into, store_at
from clearsift.sources import readers, tables
from clearsift.sources.store import Conflict, Store

DOCS = (
    "document_id long, title string, source_path string, doc_type string, required_clearance int,"
    " allowed_departments array<string>, ingested_at timestamp"
)


# A lambda travels to the tasks with its code.
encoder = lambda texts: np.array(
    [[len(t), t.startswith("passage: ") + 0.0, 1.0] for t in texts]
)


def test_upsert_keeps_ids_and_last_batch_wins(spark):
    stored = spark.createDataFrame([(5, "old", "a.md", "md", 1, None, None), (6, "b", "b.md", "md", 1, None, None)], DOCS)
    incoming = spark.createDataFrame(
        [("t1", "a.md", "md", 2, [], 1), ("t2", "a.md", "md", 3, ["HR"], 2), ("new", "c.md", "md", 1, [], 1)],
        "title string, source_path string, doc_type string, required_clearance int, allowed_departments array<string>, batch int",
    ).withColumn("ingested_at", F.current_timestamp())
    rows = {r.source_path: r for r in tables.upsert_documents(stored, incoming, "batch").collect()}
    assert set(rows) == {"a.md", "b.md", "c.md"}
    assert (rows["a.md"].document_id, rows["a.md"].title, rows["a.md"].required_clearance) == (5, "t2", 3)
    assert rows["c.md"].allowed_departments is None and rows["c.md"].document_id not in (5, 6)


def test_unknown_document_type_is_an_error(spark):
    stored = spark.createDataFrame([], DOCS)
    bad = spark.createDataFrame([("t", "a.txt", "txt", 1, None, 1)], "title string, source_path string, doc_type string, required_clearance int, allowed_departments array<string>, batch int")
    with pytest.raises(ValueError):
        tables.upsert_documents(stored, bad, "batch")


def test_replacing_chunks_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, 10, "x"), (2, 10, "y"), (3, 20, "z")], "chunk_id long, document_id long, text string")
    fresh = spark.createDataFrame([(4, 10, "n")], "chunk_id long, document_id long, text string")
    docs = spark.createDataFrame([(10,)], "document_id long")
    once = tables.replace_chunks(stored, fresh, docs)
    twice = tables.replace_chunks(once, fresh, docs)
    assert sorted(r.chunk_id for r in twice.collect()) == sorted(r.chunk_id for r in once.collect()) == [3, 4]


def test_chunks_and_vectors_must_pair(spark):
    chunks = spark.createDataFrame([(1,), (1,), (2,)], "document_id long")
    tables.require_paired(chunks, chunks)
    with pytest.raises(tables.CountMismatch):
        tables.require_paired(chunks, chunks.limit(2))


def test_colliding_ids_are_found(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "document_id long, source_path string")
    with pytest.raises(tables.IdCollision):
        tables.check_ids(rows, "document_id", ["source_path"])


def test_snapshots_are_immutable(spark, tmp_path):
    df = spark.range(3)
    tables.write_snapshot(df, str(tmp_path / "t"), "1")
    assert tables.read_snapshot(spark, str(tmp_path / "t"), "1").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_snapshot(df, str(tmp_path / "t"), "1")


def test_ingest_replaces_a_document(spark):
    def files(*rows):
        return spark.createDataFrame(rows, "path string, content string")

    docs = spark.createDataFrame([], DOCS)
    clauses = spark.createDataFrame([], "clause_id long, document_id long, code string, title string, text string")
    chunks = spark.createDataFrame(
        [], "chunk_id long, document_id long, clause_id long, ordinal int, text string, embedding array<float>"
    )
    head = "---\ntitle: T\nclearance: {}\n---\n"
    first = files(
        ("a.md", head.format(1) + "## 4.1.1 A\n" + "x" * 1000 + "\n## 4.1.2 B\ny"), ("b.md", head.format(2) + "no clause")
    )
    docs, clauses, chunks, report = ingest(first, docs, clauses, chunks, encoder, 3)
    assert sorted((r.clauses, r.chunks) for r in report.collect()) == [(0, 0), (2, 3)]
    ids = {r.source_path: r.document_id for r in docs.collect()}
    vector = chunks.head().embedding
    assert abs(sum(v * v for v in vector) - 1) < 1e-5 and vector[1] > 0
    docs, clauses, chunks, report = ingest(
        files(("a.md", head.format(3) + "## 4.1.1 A\nshort")), docs, clauses, chunks, encoder, 3
    )
    again = {r.source_path: (r.document_id, r.required_clearance) for r in docs.collect()}
    assert again == {"a.md": (ids["a.md"], 3), "b.md": (ids["b.md"], 2)}
    assert [r.text for r in chunks.collect()] == ["short"]
    assert sorted(r.code for r in clauses.collect()) == ["4.1.1", "4.1.2"]


def test_encode_checks_its_arguments(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, t string")
    with pytest.raises(ValueError, match="kind"):
        embedding.encode(rows, "t", "other", encoder, 3)
    with pytest.raises(ValueError, match="batch_size"):
        embedding.encode(rows, "t", "query", encoder, 3, batch_size=0)
    kinds = {k: embedding.encode(rows, "t", k, encoder, 3).head().embedding[1] for k in ("query", "passage")}
    assert kinds["query"] == 0 and kinds["passage"] > 0


def test_worklist_and_dimension(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    have = rows.where("t = 'b'").select(F.sha2("t", 256).alias("text_hash"))
    assert [r.t for r in embedding.pending(rows, have, "t").collect()] == ["a"]
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "id int, embedding array<float>")
    assert {r.id for r in embedding.wrong_dimension(vectors, 2).collect()} == {1, 3}


def test_readers(spark, tmp_path):
    people = tmp_path / "people.json"
    people.write_text(json.dumps([{"name": "a", "department": "HR", "clearance": 1}, {"name": "b", "department": "HR", "clearance": 2, "role": "auditor"}]))
    assert {r.name: r.role for r in readers.read_principals(spark, str(people)).collect()} == {"a": "member", "b": "auditor"}
    people.write_text(json.dumps([{"name": "a", "department": "HR", "clearance": 1, "role": "king"}]))
    with pytest.raises(readers.SourceError):
        readers.read_principals(spark, str(people))
    hosts = tmp_path / "hosts.json"
    hosts.write_text(json.dumps([{"name": "h", "department": "HR", "required_clearance": 1}]))
    with pytest.raises(readers.SourceError):
        readers.read_hosts(spark, str(hosts))
    golden = tmp_path / "golden.jsonl"
    golden.write_text('{"query": "q", "department": "HR", "clearance": "2", "relevant": ["1.1.1", "1.1.1"]}\n\n')
    row = readers.read_golden(spark, str(golden)).head()
    assert (row.clearance, row.relevant) == (2, ["1.1.1"])


def test_markdown_directory(spark, tmp_path):
    with pytest.raises(readers.SourceError):
        readers.read_markdown_dir(spark, str(tmp_path))
    (tmp_path / "b.md").write_text("two\nlines")
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "c.txt").write_text("no")
    rows = readers.read_markdown_dir(spark, str(tmp_path)).collect()
    assert sorted((r.path[-4:], r.content) for r in rows) == [("a.md", "one"), ("b.md", "two\nlines")]


def test_recent_limits(spark):
    rows = spark.createDataFrame([], "ts timestamp, record_id long, query string, session_id string, allowed boolean")
    for limit in (0, 201):
        with pytest.raises(ValueError):
            access_log.recent(rows, limit)


def test_dense_ids_follow_the_greatest(spark):
    rows = spark.range(1000).withColumnRenamed("id", "x").repartition(7)
    found, free = tables.numbered(rows, "n", 501)
    assert sorted(r.n for r in found.collect()) == list(range(501, 1501)) and free == 1501
    again, free = tables.numbered(rows.where("false"), "n", 5)
    assert again.count() == 0 and free == 5
    with pytest.raises(OverflowError):
        tables.numbered(rows, "n", (1 << 63) - 10)
    held = spark.createDataFrame([(41, "k1", 0), (7, "k2", 0)], "i long, k string, v int")
    new = spark.createDataFrame([("k2", 1, 1), ("k3", 2, 1), ("k4", 3, 1)], "k string, v int, o int")
    merged = {r.k: (r.i, r.v) for r in tables.upsert(held, new, ["k"], "o", "i").collect()}
    assert merged["k1"] == (41, 0) and merged["k2"] == (7, 1)
    assert {merged["k3"][0], merged["k4"][0]} == {42, 43}


def _bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_small_load_writes_little_and_readers_see_whole_versions(spark, tmp_path):
    head = "---\ntitle: T\nclearance: {}\n---\n## 1.1.1 A\n{}"
    files = spark.range(1000).select(
        F.concat(F.lit("d"), F.col("id"), F.lit(".md")).alias("path"),
        F.concat(F.lit(head.format(1, "")), F.repeat(F.md5(F.col("id").cast("string")), 20)).alias("content"),
    )
    store = store_at(spark, str(tmp_path / "corpus"))
    assert ingest_into(store, files, encoder, 3).count() == 1000
    first, before = store.manifest(), _bytes(tmp_path)
    one = spark.createDataFrame([("d7.md", head.format(2, "short"))], "path string, content string")
    ingest_into(store, one, encoder, 3)
    second = store.manifest()
    assert (first["number"], second["number"]) == (1, 2)
    assert _bytes(tmp_path) - before < 0.05 * before
    old = {r.source_path: r for r in store.read("documents", first).collect()}
    new = {r.source_path: r for r in store.read("documents", second).collect()}
    assert len(old) == len(new) == 1000 and old["d7.md"].document_id == new["d7.md"].document_id
    assert {p for p in old if old[p] != new[p]} == {"d7.md"} and new["d7.md"].required_clearance == 2
    seven = f"document_id = {new['d7.md'].document_id}"
    assert [r.text for r in store.read("chunks", second).where(seven).collect()] == ["short"]
    assert store.read("chunks", first).where(seven).count() == 1
    chunks = store.read("chunks", second)
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 1000
    fresh = spark.createDataFrame([("new.md", head.format(3, "text"))], "path string, content string")
    ingest_into(store, fresh, encoder, 3)
    ids = {r.source_path: r.document_id for r in store.read("documents", store.manifest()).collect()}
    assert len(set(ids.values())) == 1001 and ids["new.md"] == max(ids.values())


def test_of_two_publishers_the_second_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": "k"}, buckets=4)
    start = store.manifest()
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert store.read("t", start, schema=rows.schema).count() == 0
    held = store.publish(start, {"t": rows})
    with pytest.raises(Conflict):
        store.publish(start, {"t": rows.limit(1)})
    assert store.read("t", store.manifest()).count() == 2
    touched = store.buckets_of(rows.where("k = 1"), "k")
    left = store.read("t", held, touched).where("k <> 1")
    after = store.publish(held, {"t": left}, {"t": touched})
    assert [r.v for r in store.read("t", after).collect()] == ["b"]
    assert Store(spark, str(tmp_path), {"t": "k"}, buckets=64).buckets == 4


def test_lost_vectors_stop_an_ingest(spark, monkeypatch):
    from clearsift.plans import ingest as module

    real = module.encode
    monkeypatch.setattr(module, "encode", lambda rows, *a, **k: real(rows, *a, **k).where("length(text) > 10"))
    files = spark.createDataFrame(
        [("a.md", "---\ntitle: T\nclearance: 1\n---\n## 1.1.1 A\nshort\n## 1.1.2 B\nlonger than the others")], "path string, content string"
    )
    empty = [spark.createDataFrame([], s) for s in (schema.DOCUMENTS, schema.CLAUSES, schema.CHUNKS)]
    with pytest.raises(tables.CountMismatch):
        module.ingest(files, *empty, encoder, 3)
