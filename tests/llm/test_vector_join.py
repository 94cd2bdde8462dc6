"""The Voronoi join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearsift.llm import vector_join

SCHEMA = "vec_id long, embedding array<float>, query string, label int"


def brute(rows, k, is_query):
    """All pairs in plain Python integers."""
    kept = {}
    for key, vector in rows:
        if key is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(256 * float(x))) for x in vector]
        if any(abs(x) >= 2**31 for x in whole) or sum(x * x for x in whole) >= 2**62:
            continue
        while whole and whole[-1] == 0:
            whole.pop()
        kept[key, tuple(whole)] = None
    out = []
    for key, own in kept:
        if not is_query(key):
            continue
        scored = [
            (-sum(a * b for a, b in zip(own, other)), name) for name, other in kept if name != key
        ]
        out += [(key, i + 1, name, -s) for i, (s, name) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def joined(spark, rows, k=5, every=5, **options):
    table = spark.createDataFrame([(key, v, "x", 1) for key, v in rows], SCHEMA)
    data = vector_join.scaled(table.repartition(3))
    queries = data.where(F.col("id") % every == 0)
    return sorted(tuple(r) for r in vector_join.top_k_join(queries, data, k, **options).collect())


def clustered(seed, many, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    spread = rng.choice([0.0, 0.01, 0.3], size=(many, 1))
    found = centres[rng.integers(0, 5, many)] + spread * rng.normal(size=(many, dim))
    return found.astype(np.float32).tolist()


@pytest.mark.parametrize(
    "options",
    [{}, {"pivots": 9, "groups": 4, "query_block": 7, "data_block": 20}, {"pivots": 1, "groups": 1}],
)
def test_equals_all_pairs(spark, options):
    rows = list(enumerate(clustered(1, 160)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # a vector with many copies
    rows += [(2000 + i, [3.0, 0.5]) for i in range(3)] + [(2010, []), (2011, [0.0] * 6)]
    expected = brute(rows, 5, lambda key: key % 5 == 0)
    assert joined(spark, rows, **options) == expected


def test_odd_vectors_ids_and_repeats(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [2.0, 1.0]), (None, [1.0, 2.0]), (10, None),
        (15, [1.0, None]), (20, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (30, [1e30, 1.0]),
        (35, [-7e6, 7e6]), (40, []), (3, [-1.0, -1.0]), (4, [0.001, -0.001]),
    ]
    assert joined(spark, rows, pivots=3, groups=2) == brute(rows, 5, lambda key: key % 5 == 0)


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert joined(spark, rows, k=5) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert joined(spark, [(0, [1.0])]) == []
    assert joined(spark, []) == []
    assert joined(spark, [(1, [1.0]), (2, [1.0])]) == []  # no row is a query


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate((rng.normal(size=(40, 4)) * 3e6).astype(np.float32).tolist()))
    assert joined(spark, rows, pivots=5, groups=2) == brute(rows, 5, lambda key: key % 5 == 0)


def test_only_some_rows_are_sent(spark):
    """Far clusters are not replicated to each other's groups."""
    rng = np.random.default_rng(2)
    centres = np.eye(8) * 4
    rows = (centres[np.arange(400) % 8] + 0.01 * rng.normal(size=(400, 8))).astype(np.float32)
    whole = np.floor(256 * rows).astype(float)
    space = vector_join.Space(whole[:16], float(np.square(whole).sum(axis=1).max()))
    away = space.distances(whole, True)
    cells = away.argmin(axis=1)
    summary = [
        {"cell": int(c), "nearest": np.sort(away[cells == c, c])[:6].tolist(), "radius": 0.0}
        for c in np.unique(cells)
    ]
    asked = space.distances(whole[::50], False)
    home = asked.argmin(axis=1)
    radius = {int(c): float(asked[home == c, c].max()) for c in np.unique(home)}
    groups = vector_join._groups({c: 1 for c in radius}, space.between(), 8)
    rings, _ = vector_join._rings(summary, radius, groups, space.between(), 6, space.slack)
    sent = sum(
        int(((cells == c) & (away[:, c] >= low) & (away[:, c] <= high)).sum())
        for _, c, low, high in rings
    )
    assert sent < 0.5 * 400 * len(set(groups.values()))
