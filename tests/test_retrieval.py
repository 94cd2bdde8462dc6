import dataclasses
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clearsift.functions import scale
from clearsift.operators import audits, fusion, keyword_search, retrieval, searches
from clearsift.operators import vector_search as V
from clearsift.functions.access import class_key
from clearsift.sources import inverted, tables

CHUNKS = (
    "chunk_id long, embedding array<float>, required_clearance int, allowed_departments array<string>"
)


def requests_of(spark, rows):
    return spark.createDataFrame(
        rows, "request_id long, query_id long, department string, clearance int"
    ).withColumn("class_key", class_key("department", "clearance"))


@pytest.fixture(scope="module")
def leak_corpus(spark):
    """Public, secret and other-department chunks on two orthogonal axes."""
    rng = np.random.default_rng(7)

    def axis(n, half):
        noise = rng.uniform(0, 0.1, (n, 16))
        noise[:, half * 8 : half * 8 + 8] += 1.0
        return noise

    groups = [(2000, 1, 1, None), (2000, 0, 3, None), (50, 0, 1, ["Other"])]
    rows, number = [], 0
    for n, half, clearance, departments in groups:
        for vector in axis(n, half):
            rows.append((number, [float(np.float32(v)) for v in vector], clearance, departments))
            number += 1
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(6)
    secret, public = [1.0] * 8 + [0.0] * 8, [0.0] * 8 + [1.0] * 8
    queries = spark.createDataFrame([(0, secret), (1, public)], "query_id long, vector array<double>")
    requests = requests_of(
        spark,
        [(0, 0, "HR", 1), (1, 1, "HR", 1), (2, 0, "HR", 3), (3, 1, "HR", 3), (4, 0, "Other", 1), (5, 1, "Other", 1)],
    )
    return rows, chunks.cache(), queries, requests


def brute_force(rows, vector, department, clearance, k):
    v = np.array(vector)
    scored = []
    for number, embedding, required, allowed in rows:
        if required <= clearance and (not allowed or department in allowed):
            e = np.array(embedding)
            scored.append((round(1 - e @ v / np.linalg.norm(e) / np.linalg.norm(v), 12), number))
    return [number for _, number in sorted(scored)[:k]]


def ranked_lists(hits):
    out = {}
    for r in hits.orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append(r.chunk_id)
    return out


def test_vector_topk_equals_brute_force(leak_corpus):
    rows, chunks, queries, requests = leak_corpus
    vectors = {r.query_id: r.vector for r in queries.collect()}
    expected = {
        r.request_id: brute_force(rows, vectors[r.query_id], r.department, r.clearance, 10)
        for r in requests.collect()
    }
    hits = V.vector_topk(chunks, requests, queries, 10)
    assert ranked_lists(hits) == expected


def test_grid_equals_broadcast(leak_corpus, monkeypatch):
    rows, chunks, queries, requests = leak_corpus
    expected = ranked_lists(V.vector_topk(chunks, requests, queries, 7))
    monkeypatch.setattr(V, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(V, "BLOCK_CHUNKS", 500)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 1)
    assert ranked_lists(V.vector_topk(chunks, requests, queries, 7)) == expected


def test_small_score_blocks_change_nothing(leak_corpus, monkeypatch):
    rows, chunks, queries, requests = leak_corpus
    expected = ranked_lists(V.vector_topk(chunks, requests, queries, 7))
    monkeypatch.setattr(V, "SCORE_CELLS", 6)
    assert ranked_lists(V.vector_topk(chunks, requests, queries, 7)) == expected


def test_counts_do_not_leak(leak_corpus):
    _, chunks, queries, requests = leak_corpus
    hits = V.vector_topk(chunks, requests, queries, 10)
    counts = audits.result_counts(requests, hits)
    for by in (["query_id"], ["department", "clearance"]):
        assert all(r.equal for r in audits.count_spread(counts, by).collect())
    conflicts = audits.order_conflicts(hits.join(requests.select("request_id", "query_id"), "request_id"))
    assert all(r.inversions == 0 and r.unstable_chunks == 0 for r in conflicts.collect())


def test_naive_path_loses_rows(leak_corpus):
    _, chunks, queries, requests = leak_corpus
    naive = audits.result_counts(requests, V.naive_topk(chunks, requests, queries, 10))
    counts = {r.request_id: r.n for r in naive.collect()}
    assert counts[0] < 10 and counts[1] == 10
    spread = audits.count_spread(naive, ["department", "clearance"]).collect()
    assert not all(r.equal for r in spread)


def test_entitlement_lies_below_the_ranking(leak_corpus):
    _, chunks, queries, requests = leak_corpus
    plan = V.vector_topk(chunks, requests, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("class_keys")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ties_go_to_the_smaller_id_and_zero_vectors_last(spark):
    chunks = spark.createDataFrame(
        [(5, [1.0, 0.0], 1, None), (3, [2.0, 0.0], 1, None), (1, [0.0, 0.0], 1, None), (4, [0.0, 1.0], 1, None)], CHUNKS
    )
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    hits = V.vector_topk(chunks, requests_of(spark, [(9, 0, "HR", 1)]), queries, 10)
    rows = hits.orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [3, 5, 4, 1]
    assert rows[-1].distance is None


@pytest.mark.parametrize("partitions", ["8", "640"])
def test_topk_with_and_without_salt(spark, partitions):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(20), rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double, i int").repartition(12)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r.g, r.rank): r.i for r in scale.top_k(df, ["g"], ["v", "i"], 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    expected = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((v, i) for h, v, i in rows if h == g)[:5]):
            expected[(g, n + 1)] = r[1]
    assert got == expected


def test_keyword_matches_prefixes(spark):
    texts = [(1, None, "t", "access accessible"), (2, None, "t", "Access"), (3, "2.11.3", "t", "other"), (4, None, "t", "ac")]
    chunks = spark.createDataFrame(texts, "chunk_id long, clause_code string, doc_title string, text string")
    posting = keyword_search.postings(chunks)
    queries = spark.createDataFrame(
        [(0, "Access policy"), (1, "2.11"), (2, "? a"), (3, "acc access")], "query_id long, query string"
    )
    terms = keyword_search.request_terms(queries)
    got = {(r.query_id, r.chunk_id): r.score for r in keyword_search.keyword_scores(posting, terms).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.5, (1, 3): 1.0, (3, 1): 2.0, (3, 2): 1.0}


def test_keyword_weight_saturates(spark):
    chunks = spark.createDataFrame([(1, "w w w")], "chunk_id long, text string").select(
        "chunk_id", F.lit(None).cast("string").alias("clause_code"), F.lit("").alias("doc_title"), "text"
    )
    row = keyword_search.postings(chunks).where("lexeme = 'w'").head()
    assert row.tf == 3 and abs(row.weight - (1 + 1 / 4 + 1 / 9)) < 1e-12


def test_keyword_topk_respects_entitlements(spark):
    chunks = spark.createDataFrame(
        [(1, None, "t", "word", 3, None), (2, None, "t", "word word", 1, ["Dev"]), (3, None, "t", "word", 1, [])],
        "chunk_id long, clause_code string, doc_title string, text string, required_clearance int, allowed_departments array<string>",
    )
    queries = spark.createDataFrame([(0, "word")], "query_id long, query string")
    requests = requests_of(spark, [(1, 0, "HR", 1), (2, 0, "Dev", 1), (3, 0, "Dev", 3)])
    hits = keyword_search.keyword_topk(keyword_search.postings(chunks), chunks, requests, queries, 10)
    assert ranked_lists(hits) == {1: [3], 2: [2, 3], 3: [2, 1, 3]}


def twin_rrf(lists, k=60):
    scores, order = {}, []
    for ranking in lists:
        for place, item in enumerate(dict.fromkeys(ranking)):
            scores[item] = scores.get(item, 0.0) + 1 / (k + place)
            if item not in order:
                order.append(item)
    return sorted(scores, key=lambda i: (-scores[i], order.index(i))), scores


def test_rrf_against_a_twin(spark):
    rng = random.Random(11)
    cases = {g: [[rng.randrange(8) for _ in range(rng.randrange(7))] for _ in range(2)] for g in range(150)}
    rows = [(g, n, p, i) for g, ls in cases.items() for n, l in enumerate(ls) for p, i in enumerate(l)]
    df = spark.createDataFrame(rows, "g int, list_no int, pos int, id int")
    got = {}
    for r in fusion.rrf(df, ["g"], "id").orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append((r.id, r.score))
    for g, lists in cases.items():
        order, scores = twin_rrf(lists)
        assert got.get(g, []) == [(i, scores[i]) for i in order]


def test_rrf_rejects_bad_k(spark):
    df = spark.createDataFrame([(1, 0, 0, 1)], "g int, list_no int, pos int, id int")
    with pytest.raises(ValueError):
        fusion.rrf(df, ["g"], "id", k=0)


def test_session_evidence_and_folding(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1, 7), (1, 1, 2, 8), (1, 2, 1, 8), (1, 2, 2, 9)], "session_id int, call_no int, rank int, chunk_id long"
    )
    got = retrieval.session_evidence(hits).orderBy("call_no", "rank").collect()
    assert [(r.chunk_id, r.call_no) for r in got] == [(7, 1), (8, 1), (9, 2)]
    coded = spark.createDataFrame(
        [(1, 1, 7, "1.1.1"), (1, 2, 8, None), (1, 3, 9, "1.1.1"), (1, 4, 10, None)],
        "request_id int, rank int, chunk_id long, clause_code string",
    )
    folded = retrieval.fold_by_clause(coded).orderBy("rank").collect()
    assert [(r.chunk_id, r.chunk_count) for r in folded] == [(7, 2), (8, 1), (10, 1)]


def test_evidence_blocks(spark):
    requests = spark.createDataFrame([(1,), (2,)], "request_id long")
    hits = spark.createDataFrame(
        [(1, 2, None, "T", "b"), (1, 1, "1.1.1", "<T>", "line1\nline2")],
        "request_id long, rank int, clause_code string, doc_title string, text string",
    )
    blocks = dict(retrieval.evidence_blocks(hits, requests).collect())
    assert blocks[1] == "<규정>\n[1.1.1] ‹T›\nline1\nline2\n\n[조항 밖] T\nb\n</규정>"
    assert blocks[2] == "관련된 조항을 찾지 못했다."


@pytest.fixture(scope="module")
def worded(spark):
    """Texts of a small vocabulary under mixed permissions, with questions."""
    rng = random.Random(5)
    words = [a + b for a in ("al", "be", "ga", "de", "zz") for b in ("", "pha", "ta", "mma", "x")]
    rows = []
    for n in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))
        vector = [float(rng.randrange(-3, 4)) + 0.5 for _ in range(4)]
        rows.append((n, n % 7, None, None, "t", text, vector, rng.randrange(1, 4), rng.choice([None, [], ["HR"], ["HR", "Dev"]])))
    chunks = spark.createDataFrame(
        rows,
        "chunk_id long, document_id long, clause_id long, clause_code string, doc_title string, text string,"
        " embedding array<float>, required_clearance int, allowed_departments array<string>",
    ).cache()
    texts = [(q, " ".join(rng.sample(words, 4)), [1.0, q + 1.0, -1.0, 0.5]) for q in range(9)] + [(9, "? a", [1.0, 0.0, 0.0, 1.0])]
    queries = spark.createDataFrame(texts, "query_id long, query string, vector array<double>").cache()
    asked = [(i, i % 10, ("HR", "Dev", "Ops")[i % 3], i % 3 + 1) for i in range(60)]
    return chunks, queries, requests_of(spark, asked).cache()


def test_stored_table_opens_only_files_with_matched_words(spark, worded, tmp_path):
    chunks, queries, requests = worded
    posting = keyword_search.postings(chunks)
    expected = ranked_lists(keyword_search.keyword_topk(posting, chunks, requests, queries, 10))
    table = inverted.write_inverted(posting, str(tmp_path / "index"), 6)
    assert len(table.all().inputFiles()) > 3 and table.all().count() == posting.count()
    assert ranked_lists(keyword_search.keyword_topk(table, chunks, requests, queries, 10)) == expected
    few = queries.where("query_id < 0").union(spark.createDataFrame([(1, "zz zzx", [1.0] * 4)], queries.schema))
    hits = keyword_search.keyword_topk(table, chunks, requests, few, 10)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    opened = {f for f in hits.inputFiles() if "/postings/" in f}
    assert "FileScan parquet" in plan and 0 < len(opened) < len(table.all().inputFiles())
    lists = ranked_lists(hits)
    assert lists and lists == ranked_lists(keyword_search.keyword_topk(posting, chunks, requests, few, 10))
    with pytest.raises(Exception, match="(?i)exist"):
        inverted.write_inverted(posting, str(tmp_path / "index"))


def test_scores_by_joins_equal_those_added_in_tasks(worded, monkeypatch):
    chunks, queries, requests = worded
    posting = keyword_search.postings(chunks)

    def answers():
        hits = keyword_search.keyword_topk(posting, chunks, requests, queries, 10).collect()
        return sorted((r.request_id, r.rank, r.chunk_id, r.score) for r in hits)

    expected = answers()
    assert len(expected) > 300 and 9 not in {r % 10 for r, *_ in expected}
    monkeypatch.setattr(keyword_search, "ADDED", 40)
    monkeypatch.setattr(keyword_search, "SCORE_CELLS", 30)
    assert answers() == expected
    monkeypatch.setattr(keyword_search, "MATCHED_ROWS", 3)
    assert answers() == expected
    monkeypatch.setattr(keyword_search, "ASKED_TERMS", 0)
    assert answers() == expected
    monkeypatch.setattr(searches, "BEST_ROWS", 10)  # more searches than fit
    assert answers() == expected


def test_words_are_searched_in_the_texts_as_in_an_index(worded, monkeypatch):
    chunks, queries, requests = worded
    posting = keyword_search.postings(chunks)

    def answers(index):
        best, _ = keyword_search.search_keyword(index, chunks, requests, queries, 7)
        return {(r.query_id, r.class_key, r["rank"]): (r.chunk_id, r.score) for r in best.collect()}

    def totals():
        return {r[0]: (r[1], round(r[2], 6)) for r in keyword_search.match_totals(chunks, queries).collect()}

    scores = keyword_search.keyword_scores(posting, keyword_search.request_terms(queries))
    counted = scores.groupBy("query_id").agg(F.count("*"), F.sum("score")).collect()
    expected, sums = answers(posting), {r[0]: (r[1], round(r[2], 6)) for r in counted}
    assert len(expected) > 100 and answers(None) == expected and totals() == sums
    monkeypatch.setattr(keyword_search, "KNOWN_WORDS", 2)
    assert answers(None) == expected
    monkeypatch.setattr(keyword_search, "ASKED_TERMS", 1)  # by joins
    assert answers(None) == expected and totals() == sums


def test_hybrid_search_equals_its_parts(worded):
    chunks, queries, requests = worded
    posting = keyword_search.postings(chunks)
    near = ranked_lists(V.vector_topk(chunks, requests, queries, 25))
    said = ranked_lists(keyword_search.keyword_topk(posting, chunks, requests, queries, 25))
    got = ranked_lists(retrieval.hybrid_search(chunks, posting, requests, queries, 5))
    for number in {r.request_id for r in requests.collect()}:
        order, _ = twin_rrf([near.get(number, []), said.get(number, [])])
        assert got.get(number, []) == order[:5]


def test_a_search_is_built_in_few_jobs(spark, worded, tmp_path):
    chunks, queries, requests = worded
    table = inverted.write_inverted(keyword_search.postings(chunks), str(tmp_path / "index"))
    tracker = spark.sparkContext.statusTracker()
    for search in (
        lambda: keyword_search.keyword_topk(table, chunks, requests, queries, 10),
        lambda: retrieval.hybrid_search(chunks, table, requests, queries, 5),
    ):
        before = len(tracker.getJobIdsForGroup(None))
        hits = search()
        built = len(tracker.getJobIdsForGroup(None)) - before
        assert built < 10 and hits.count() > 100


def test_candidates_are_counted_in_the_search_itself(worded):
    """The scorer's own input is observed: one hidden chunk more, and it shows."""
    chunks, queries, requests = worded
    found = searches.searches_of(requests, queries, 5, chunks, "vector")

    def differences(sets):
        counted = audits.Candidates()
        given = dataclasses.replace(found, sets=sets)
        hits, _ = V.search_topk(chunks, requests, queries, 5, searches=given, candidates=counted)
        hits.count()
        rows = counted.compared(chunks, requests).where("scored <> allowed").collect()
        return {r.class_key: r.scored - r.allowed for r in rows}

    assert differences(found.sets) == {}
    signature = (F.col("required_clearance") == 3) & (F.array_join("access_keys", ",") == "*")
    leaking = F.when(signature, F.array_union("class_keys", F.array(F.lit("1|HR")))).otherwise(F.col("class_keys"))
    hidden = chunks.where("required_clearance = 3 AND coalesce(size(allowed_departments), 0) <= 0").count()
    assert differences(found.sets.withColumn("class_keys", leaking)) == {"1|HR": hidden}
    one = chunks.where("required_clearance = 3").limit(1)
    more = chunks.union(one.withColumn("required_clearance", F.lit(1)).withColumn("allowed_departments", F.array(F.lit("HR"))))
    counted = audits.Candidates()
    V.search_topk(more, requests, queries, 5, searches=found, candidates=counted)[0].count()
    assert counted.compared(chunks, requests).where("scored <> allowed").count() >= 1


def test_only_visible_signatures_are_opened(spark, worded, tmp_path):
    chunks, queries, requests = worded
    tables.write_by_signature(chunks, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    low = requests.where("clearance = 1")
    hits = V.vector_topk(stored, low, queries, 5, chunks)
    assert ranked_lists(hits) == ranked_lists(V.vector_topk(chunks, low, queries, 5))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [signature" in plan
    scan = next(line for line in plan.splitlines() if "PartitionFilters: [signature" in line)
    assert "1|" in scan and "2|" not in scan and "3|" not in scan
    every = V.vector_topk(stored, requests, queries, 5, chunks)
    assert ranked_lists(every) == ranked_lists(V.vector_topk(chunks, requests, queries, 5))


def _clustered(seed, many, width=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 8))
    rows = centres[rng.integers(0, 20, many)] + width * rng.normal(size=(many, 8))
    rows[rng.integers(0, many, 5)] = 0.0
    return rows.astype(np.float32)


def test_bounds_skip_most_pairs_and_change_nothing(monkeypatch):
    chunks, queries = _clustered(1, 4000), _clustered(2, 240)
    chunks[50:60] = chunks[49]  # ties
    asked = [["a"], ["b"], ["a", "b"]]
    searches_ = pa.table(
        {"query_id": list(range(240)), "vector": [v.astype(float).tolist() for v in queries],
         "class_keys": [asked[i % 3] for i in range(240)]}
    )
    held = pa.array([[["a", "b"], ["b"], ["a"], ["c"]][i % 4] for i in range(4000)])
    schema = V.T.StructType(
        [V.T.StructField("query_id", V.T.LongType()), V.T.StructField("class_key", V.T.StringType()),
         V.T.StructField("chunk_id", V.T.LongType()), V.T.StructField("distance", V.T.DoubleType())]
    )

    def found(pivots):
        monkeypatch.setattr(V, "PIVOTS", pivots)
        nearest = V._NearestVectors(searches_, 5)
        for at in range(0, 4000, 1500):
            ids = pa.array(range(at, min(at + 1500, 4000)))
            vectors = pa.array(chunks[at : at + 1500].tolist(), pa.list_(pa.float32()))
            nearest.add(ids, vectors, held.slice(at, 1500))
        return sorted(map(str, nearest.table(schema).to_pylist())), nearest.scored

    plain, all_pairs = found(1)
    bounded, scored = found(64)
    assert all_pairs == 4000 * 240 and scored < all_pairs / 2
    assert bounded == plain and len(plain) == 5 * (240 + 80)


def test_many_queries_equal_brute_force(spark):
    chunks, queries = _clustered(3, 500, 0.3), _clustered(4, 60, 0.3)
    rows = [(i, v.tolist(), i % 3 + 1, None if i % 2 else ["HR"]) for i, v in enumerate(chunks)]
    asked = [(i, i % 60, ("HR", "Dev")[i % 2], i % 3 + 1) for i in range(120)]
    vectors = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    requests = requests_of(spark, asked)
    got = ranked_lists(V.vector_topk(spark.createDataFrame(rows, CHUNKS), requests, vectors, 4))
    for number, query, department, clearance in asked:
        if np.any(queries[query]):
            own = [r for r in rows if any(r[1])]
            assert got[number] == brute_force(own, queries[query].astype(float), department, clearance, 4)
