import math
import random

import pytest

from clearsift.operators import citations, evaluation


def twin(retrieved, relevant, k):
    top = list(dict.fromkeys(c for c in retrieved if c is not None))[:k]
    if not relevant:
        return 0.0, 0.0, 0.0
    places = [i for i, c in enumerate(top, 1) if c in relevant]
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(relevant), k) + 1))
    return (
        len(places) / len(relevant),
        1 / places[0] if places else 0.0,
        sum(1 / math.log2(i + 1) for i in places) / ideal,
    )


def test_metrics_against_a_twin(spark):
    rng = random.Random(2)
    codes = [f"1.1.{n}" for n in range(9)]
    cases = {
        i: ([rng.choice(codes + [None]) for _ in range(rng.randrange(9))], set(rng.sample(codes, rng.randrange(4))))
        for i in range(120)
    }
    golden = spark.createDataFrame([(i,) for i in cases], "request_id long")
    retrieved = spark.createDataFrame(
        [(i, n, c) for i, (got, _) in cases.items() for n, c in enumerate(got, 1)], "request_id long, rank int, code string"
    )
    relevant = spark.createDataFrame([(i, c) for i, (_, rel) in cases.items() for c in rel], "request_id long, code string")
    rows = evaluation.query_metrics(golden, retrieved, relevant, 4).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert (r.recall, r.mrr, r.ndcg) == pytest.approx(twin(*cases[r.request_id], 4), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 30, 41])
def test_summary_takes_the_boundary_element(spark, n):
    values = [float(v * v % 97) for v in range(n)]
    rows = spark.createDataFrame([(v, 0.5, 0.5, 0.5) for v in values], "latency_ms double, recall double, mrr double, ndcg double")
    got = evaluation.summary(rows).head()
    assert got.p95_ms == pytest.approx(sorted(values)[min(n - 1, int(n * 0.95))])
    assert got.n_queries == n


def test_empty_corpus_is_refused(spark):
    metrics = spark.createDataFrame([(1, 0.0)], "request_id long, recall double")
    with pytest.raises(evaluation.EmptyCorpus):
        evaluation.report(metrics, metrics.where("false"))


def test_citations(spark):
    answers = spark.createDataFrame(
        [
            (1, "By 2.2.2 and [1.1.1], again [1.1.1] and [9.9.9]; on 2026.09.04"),
            (2, "3.3.3 then [3.3.3] and bare 4.4.4"),
            (3, "nothing"),
        ],
        "answer_id long, answer string",
    )
    hits = spark.createDataFrame(
        [(1, "1.1.1"), (1, "2.2.2"), (1, None), (2, "5.5.5"), (3, "1.1.1")], "answer_id long, clause_code string"
    )
    found = citations.citations(answers, hits)
    rows = [(r.answer_id, r.code, r.status) for r in found.orderBy("answer_id", "position").collect()]
    assert rows == [
        (1, "2.2.2", "cited"),
        (1, "1.1.1", "cited"),
        (1, "9.9.9", "fabricated"),
        (2, "3.3.3", "fabricated"),
    ]
    used, related = citations.split_evidence(hits, found)
    assert used.count() == 2 and related.count() == 3
