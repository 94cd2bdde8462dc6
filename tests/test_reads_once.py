"""Loading reads its files once, and files of many documents lie in few folders."""

import random
import string
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from clearsift.functions.scale import cut, discard
from clearsift.plans import table_queries
from clearsift.plans.ingest import ingest_into, parsed_files, store_at


def test_files_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def content(number):
        read.add(1)
        return f"---\ntitle: t\nclearance: 1\n---\n## 1.1.{number} Head\ntext"

    made = F.udf(content).asNondeterministic()
    files = spark.range(20).select(F.concat("id", F.lit(".md")).alias("path"), made("id").alias("content"))
    assert parsed_files(files).count() == 20
    assert read.value == 20


def test_policies_are_one_file_each_in_one_folder(spark, tmp_path):
    files = spark.createDataFrame(
        [(n, f'---\ntitle: "a {n}"\n---\nbody\n' if n % 2 else "clearance: 1\nbody") for n in range(9)],
        "document_id long, content string",
    )
    table_queries._write_policies(files, f"{tmp_path}/policies")
    found = [p for p in Path(f"{tmp_path}/policies").rglob("part-*") if p.is_file()]
    assert len(found) == 9 and {p.parent for p in found} == {tmp_path / "policies"}


def test_policies_of_one_number_are_files_of_their_own(spark, tmp_path, monkeypatch):
    """Tasks write the texts as Spark's writer would, also where a number repeats."""
    rows = [(1, "clearance: 1\nböse"), (1, "---\ntitle: a 1\n---\n"), (None, "---\nx"), (2, None)] * 5
    documents = spark.createDataFrame(rows, "document_id long, content string").repartition(3)
    texts = []
    for name in ("tasks", "writer"):
        table_queries._write_policies(documents, f"{tmp_path}/{name}")
        texts.append(sorted(p.read_bytes() for p in Path(f"{tmp_path}/{name}").glob("part-*")))
        made = {p.name for p in Path(f"{tmp_path}/{name}").iterdir()}
        monkeypatch.setattr(table_queries.files, "local_folder", lambda spark, path: None)
        if name == "tasks":  # no file of Hadoop's, which starts a process for each
            assert len(made) == 20 and not any(n.startswith(("_", ".")) for n in made)
    assert texts[0] == texts[1]


def test_texts_are_stored_a_few_times_only(spark, tmp_path):
    """Files and parsed files are removed once read, and clauses and chunks stored once."""
    size = 2_000_000
    body = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=size))
    head = "---\ntitle: T\nclearance: 1\n---\n## 1.1.1 A\n"
    source = spark.createDataFrame([("a.md", head + body)], "path string, content string")
    encoder = lambda texts: np.ones((len(texts), 1))
    store = store_at(spark, str(tmp_path / "corpus"))
    cut(spark.range(1))
    kept = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    stored = lambda: {p: p.stat().st_size for p in kept.rglob("part-*")}
    before = stored()
    report = ingest_into(store, source, encoder, 1)
    copies = sum(n > size / 2 for p, n in stored().items() if p not in before)
    assert report.count() == 1 and copies <= 4
    assert store.read("clauses", store.manifest()).first().text == body
    held = stored()
    again = cut(spark.range(5))
    assert set(stored()) > set(held)
    discard(again)
    discard(spark.range(3))
    assert not set(stored()) - set(held)
