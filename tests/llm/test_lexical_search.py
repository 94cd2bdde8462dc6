"""The automaton search against counting every term of every document."""

import math
import random
import re

import pytest

from clearsift.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


def brute(docs, items, k=10):
    docs = [(key, terms_of(text)) for key, text in docs]
    docs = [(key, t) for key, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    names = {}
    for name, text in dict.fromkeys(items):
        names.setdefault(name, []).extend(terms_of(text))
    out = []
    for name, wanted in names.items():
        df = {t: sum(t in held for _, held in docs) for t in set(wanted)}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items() if n}
        scored = []
        for key, held in docs:
            m = 25 + (75 * len(held) * n_docs) // n_terms
            score = sum(
                weight[t] * ((10**9 * tf) // (1000 * tf + 8 * m)) for t in wanted if (tf := held.count(t))
            )
            if score > 0:
                scored.append((-score, (key is None, key or 0), key))
        scored.sort()
        out += [(name, i + 1, key, -s) for i, (s, _, key) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **options):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, rank int")
    items = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, lexical_search.search(docs.repartition(4), items, **options).collect()), key=repr)


def corpus(seed):
    random.seed(seed)
    words = ["alpha", "Beta", "gamma", "é", "Ñu", "ñu", "x1", "1", "al", "ha", "漢字", "it", "s"]
    breaks = [" ", "\n", "-", ", ", "'", "\0", "  ", "\x7f"]
    make = lambda n: "".join(random.choice(words) + random.choice(breaks) for _ in range(n))
    docs = [(i, make(random.choice([0, 1, 3, 30, 200]))) for i in range(80)]
    docs += [(7, docs[5][1]), (None, "alpha beta"), (500, None), (501, ""), (502, " ., "), (503, "beta " * 50_000)]
    docs += [(600 + i, "same text of é") for i in range(30)]
    items = [(i, make(random.choice([1, 4, 12]))) for i in range(9)]
    items += [(20, None), (21, ""), (None, "gamma é é"), (0, "x1 more"), (22, "nowhere"), items[2], (23, "same of")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_counting(spark, seed):
    docs, items = corpus(seed)
    assert searched(spark, docs, items) == brute(docs, items)


def test_items_in_parts_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "POSTINGS", 9)
    monkeypatch.setattr(lexical_search, "CELLS", 5)
    docs, items = corpus(3)
    assert searched(spark, docs, items, k=2) == brute(docs, items, 2)


def test_nothing_to_search(spark):
    docs, items = corpus(4)
    assert searched(spark, [], items) == []
    assert searched(spark, docs, []) == []
    assert searched(spark, docs, [(1, " . "), (2, None)]) == []


def test_best_rows_survive_pruning():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, size=(5000, 7))
    best = lexical_search._Best(3)
    for start in range(0, 5000, 50):
        best.add(scores[start : start + 50], pa.array(range(9000 - start, 8950 - start, -1)))
        best._prune()
    places, ids, found = best.rows()
    expected = []
    for place in range(7):
        rows = sorted((-int(s), 9000 - i) for i, s in enumerate(scores[:, place]) if s > 0)[:3]
        expected += [(place, key, -s) for s, key in rows]
    assert list(zip(places.tolist(), ids.to_pylist(), found.tolist())) == expected
