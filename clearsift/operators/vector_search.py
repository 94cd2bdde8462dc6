"""Exact cosine top-k over the chunks each principal may see."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.functions.access import visible
from clearsift.functions.scale import hinted, settle, top_k
from clearsift.operators.audits import Candidates
from clearsift.operators.entitlements import with_sets
from clearsift.operators.searches import (
    BROADCAST_CELLS, BROADCAST_QUERIES, Searches, searches_of,
)

# Beyond the bounds of broadcast searches, chunks and searches meet in a shuffled
# grid of bounded blocks.
BLOCK_CHUNKS = 50_000
BLOCK_QUERIES = 2_000
# Distances computed at once, which bounds the memory of one task.
SCORE_CELLS = 8_000_000
# Groups of chunks that are bounded as one, and the queries that make one worth it.
PIVOTS = 64
QUERIES_PER_PIVOT = 8
BOUND_SLACK = 1e-7
# Distances are compared at this many decimals, so equal vectors tie exactly
# and the tie goes to the smaller chunk id.
DISTANCE_DECIMALS = 12

EVERYONE = "*"


def vector_topk(
    chunks: DataFrame,
    requests: DataFrame,
    queries: DataFrame,
    k: int,
    permissions: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` nearest visible chunks of every request.

    ``chunks``: chunk_id, embedding, required_clearance, allowed_departments.
    ``requests``: request_id, query_id, department, clearance, class_key.
    ``queries``: query_id, vector.  Requests sharing a query and a class are
    searched once.
    Returns request_id, rank, chunk_id, distance.
    """
    ranked, bound = search_topk(chunks, requests, queries, k, permissions)
    return requests.select("request_id", "query_id", "class_key").join(
        hinted(ranked, bound), ["query_id", "class_key"]
    ).select("request_id", "rank", "chunk_id", "distance")


def search_topk(
    chunks: DataFrame,
    requests: DataFrame,
    queries: DataFrame,
    k: int,
    permissions: DataFrame | None = None,
    searches: Searches | None = None,
    candidates: Candidates | None = None,
) -> tuple[DataFrame, int | None]:
    """As ``vector_topk`` but one result list per distinct (query, class), and
    a bound on its rows when one is known.  ``searches`` may hand over searches
    collected with their ``vector`` before; ``candidates`` counts, while the
    search runs, what its scorer is given."""
    if searches is None:
        permissions = chunks if permissions is None else permissions
        searches = searches_of(requests, queries, k, permissions, "vector")
    seen = with_sets(chunks, searches.sets).select("chunk_id", "embedding", "class_keys")
    if candidates is not None:
        seen = candidates.observe(seen, searches.class_keys)
    return _ranked(seen, searches, k), searches.bound(k)


def naive_topk(
    chunks: DataFrame, requests: DataFrame, queries: DataFrame, k: int
) -> DataFrame:
    """The leaky order of work, for audits only: rank everything, then filter.

    Lost rows shrink the result, which tells a principal that hidden chunks
    are near the query.  ``naive_rank`` is the rank before filtering.
    """
    everyone = chunks.select(
        "chunk_id", "embedding", F.array(F.lit(EVERYONE)).alias("class_keys")
    )
    asked = requests.withColumn("class_key", F.lit(EVERYONE))
    searches = searches_of(asked, queries, k, None, "vector")
    ranked = _ranked(everyone, searches, k).drop("class_key")
    permitted = chunks.select("chunk_id", "required_clearance", "allowed_departments")
    held = settle(ranked).join(permitted, "chunk_id")
    return (
        requests.select("request_id", "query_id", "department", "clearance")
        .join(settle(held), "query_id")
        .where(visible("required_clearance", "allowed_departments", "clearance", "department"))
        .select("request_id", F.col("rank").alias("naive_rank"), "chunk_id", "distance")
    )


def _ranked(seen: DataFrame, searches: Searches, k: int) -> DataFrame:
    schema = result_schema(searches.queries, seen)
    few = searches.table
    if few is not None:
        cells = len(few["vector"].combine_chunks().flatten())
        few = few if few.num_rows <= BROADCAST_QUERIES and cells <= BROADCAST_CELLS else None
    if few is not None:
        local = seen.mapInArrow(_scanner(few, k, schema), schema)
    else:
        local = _grid(seen, searches.queries, k, schema)
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
    return top_k(local, ["query_id", "class_key"], order, k)


def result_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("class_key", T.StringType()),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _scanner(searches: pa.Table, k: int, schema: T.StructType):
    def scan(batches):
        nearest = _NearestVectors(searches, k)
        for batch in batches:
            nearest.add(
                batch.column("chunk_id"), batch.column("embedding"), batch.column("class_keys")
            )
        yield from nearest.table(schema).to_batches()

    return scan


def _grid(seen: DataFrame, searches: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Every chunk block meets every request block; both are cut by id hash, so
    blocks stay even whatever one class or document holds."""
    chunk_blocks = seen.count() // BLOCK_CHUNKS + 1
    query_blocks = searches.count() // BLOCK_QUERIES + 1
    left = seen.select(
        "*",
        F.pmod(F.xxhash64("chunk_id"), F.lit(chunk_blocks)).alias("chunk_block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    )
    right = searches.select(
        "*",
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.lit(chunk_blocks - 1).cast("long"))
        ).alias("chunk_block"),
    )
    keys = ["chunk_block", "query_block"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        nearest = _NearestVectors(right, k)
        for batch in left.to_batches(max_chunksize=10_000):
            nearest.add(
                batch.column("chunk_id"), batch.column("embedding"), batch.column("class_keys")
            )
        return nearest.table(schema)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


class Nearest:
    """Running nearest chunks of a block of searches (k rows kept per search)."""

    def __init__(self, searches: pa.Table, k: int):
        self.k = k
        self.query_ids = searches.column("query_id").to_pylist()
        asked = {}
        for number, classes in enumerate(searches.column("class_keys").to_pylist()):
            for key in classes:
                asked.setdefault(key, []).append(number)
        self.queries_of = {key: np.array(numbers) for key, numbers in asked.items()}
        self.best = {}
        # The distance of each class's k-th row for each query that has so many.
        self.kth = {key: np.full(len(q), np.inf) for key, q in self.queries_of.items()}

    def limits(self) -> np.ndarray:
        """For each query the distance beyond which no class can use a row."""
        found = np.full(len(self.query_ids), -np.inf)
        for key, queries in self.queries_of.items():
            found[queries] = np.maximum(found[queries], self.kth[key])
        return found

    def offer(self, ids: np.ndarray, distances: np.ndarray, class_keys, active=None) -> None:
        """Chunks with their distance to every query, or to the ``active`` ones in
        order, where NaN is no result, and the classes that may see them."""
        members = class_keys.flatten().dictionary_encode()
        codes = members.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(ids)), _lengths(class_keys))
        for code, key in enumerate(members.dictionary.to_pylist()):
            queries = self.queries_of.get(key)
            if queries is None:
                continue
            mine = rows[codes == code]
            part = np.arange(len(queries))
            if active is not None:
                places = np.minimum(np.searchsorted(active, queries), len(active) - 1)
                part = np.flatnonzero(active[places] == queries)
                found = distances[np.ix_(mine, places[part])]
            elif len(queries) == len(self.query_ids):
                found = distances[mine]
            else:
                found = distances[np.ix_(mine, queries)]
            if len(mine) and len(part):
                self._merge(key, part, ids[mine], found)

    def _merge(self, key, part, ids, distances):
        """Take the rows of a block into one class's nearest, for all queries at
        these places of the class at once.  ``best`` holds flat rows in order of
        query, distance and id, at most ``k`` for each query."""
        kth = self.kth[key]
        bound = kth[part]
        if len(ids) > self.k:
            least = np.partition(distances, self.k - 1, axis=0)[self.k - 1]
            bound = np.minimum(bound, np.where(np.isnan(least), np.inf, least))
        column, row = np.nonzero((distances <= bound).T)
        if not len(column):
            return
        taken, found, column = ids[row], distances[row, column], part[column]
        if key in self.best:
            held = self.best[key]
            column = np.concatenate([held[0], column])
            found = np.concatenate([held[1], found])
            taken = np.concatenate([held[2], taken])
        order = np.lexsort((taken, found, column))
        column = column[order]
        starts = np.searchsorted(column, np.arange(len(kth)))
        near = np.arange(len(column)) - starts[column] < self.k
        column, order = column[near], order[near]
        self.best[key] = (column, found[order], taken[order])
        many = np.bincount(column, minlength=len(kth))
        full = many == self.k
        kth[full] = found[order][np.cumsum(many)[full] - 1]

    def table(self, schema: T.StructType) -> pa.Table:
        query_ids, keys, ids, distances = [], [], [], []
        for key, (column, found, taken) in self.best.items():
            queries = self.queries_of[key]
            query_ids += [self.query_ids[n] for n in queries[column]]
            keys += [key] * len(column)
            ids += taken.tolist()
            distances += [None if np.isinf(d) else float(d) for d in found]
        columns = [query_ids, keys, ids, distances]
        return pa.table(
            {f.name: pa.array(c, type=_arrow_type(f)) for f, c in zip(schema.fields, columns)}
        )


class _NearestVectors(Nearest):
    """Nearest by cosine distance.

    Where there are many queries, chunks are grouped around pivots.  The angle
    between a query and a pivot, less the widest angle of the group, bounds every
    distance to the group from below; groups beyond a query's ``k``-th distance
    in all its classes are not scored for it.  The bound is exact, so are results.
    """

    def __init__(self, searches: pa.Table, k: int):
        super().__init__(searches, k)
        self.matrix = _matrix(searches.column("vector").combine_chunks(), len(self.query_ids))
        self.norms = np.linalg.norm(self.matrix, axis=1)
        self.groups = min(PIVOTS, len(self.query_ids) // QUERIES_PER_PIVOT)
        self.pivots, self.scored = None, 0

    def add(self, ids, embeddings, class_keys):
        if not self.query_ids:
            return
        step = max(1, SCORE_CELLS // len(self.query_ids))
        for at in range(0, len(ids), step):
            part = [x.slice(at, step) for x in (ids, embeddings, class_keys)]
            vectors = _matrix(part[1], len(part[0]), self.matrix.shape[1])
            ids_of = np.asarray(part[0].to_pylist())
            if self.groups < 2:
                self._score(ids_of, vectors, part[2])
            else:
                self._score_groups(ids_of, vectors, part[2])

    def _score(self, ids, vectors, class_keys, active=None):
        matrix, norms = self.matrix, self.norms
        if active is not None:
            matrix, norms = matrix[active], norms[active]
        scale = np.linalg.norm(vectors, axis=1)[:, None] * norms[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            distances = np.round(1.0 - (vectors @ matrix.T) / scale, DISTANCE_DECIMALS)
        self.scored += distances.size
        self.offer(ids, np.where(scale == 0, np.inf, distances), class_keys, active)

    def _score_groups(self, ids, vectors, class_keys):
        norms = np.linalg.norm(vectors, axis=1)
        zero = np.flatnonzero(norms == 0)
        if len(zero):  # no direction: behind all others
            self._score(ids[zero], vectors[zero], class_keys.take(pa.array(zero)))
        units = vectors / np.where(norms > 0, norms, 1)[:, None]
        if self.pivots is None:
            some = np.flatnonzero(norms > 0)
            if not len(some):
                return
            some = some[:: max(1, len(some) // self.groups)][: self.groups]
            self.pivots = units[some]
            turned = self.matrix / np.where(self.norms > 0, self.norms, 1)[:, None]
            self.angles = np.arccos(np.clip(turned @ self.pivots.T, -1, 1))
            self.angles[self.norms == 0] = 0
            self.home = self.angles.argmin(axis=1)
        near = units @ self.pivots.T
        cells = np.where(norms > 0, near.argmax(axis=1), -1)
        groups = []
        for cell in np.unique(cells[cells >= 0]).tolist():
            rows = np.flatnonzero(cells == cell)
            width = np.arccos(np.clip(near[rows, cell].min(), -1, 1))
            least = 1 - np.cos(np.maximum(self.angles[:, cell] - width, 0)) - BOUND_SLACK
            groups.append((cell, rows, class_keys.take(pa.array(rows)), least))
        # First each query's own group, which gives it rows to compare with.
        for first in (True, False):
            for cell, rows, keys, least in groups:
                wanted = (self.home == cell) == first
                active = np.flatnonzero(wanted & (least <= self.limits()))
                if len(active):
                    self._score(ids[rows], vectors[rows], keys, active)


def _arrow_type(field: T.StructField) -> pa.DataType:
    types = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}
    return types.get(field.dataType, pa.string())


def _lengths(lists) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _matrix(lists, rows: int, width: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix.  A missing, null-holding or ragged one is an
    error: flattened it would shift all others."""
    lengths = _lengths(lists)
    width = int(lengths[0]) if width is None and rows else width
    flat = lists.flatten()
    if lists.null_count or flat.null_count or (lengths != width).any():
        raise ValueError("vectors must be complete and of one length; see embedding.wrong_dimension")
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows, width) if rows else values.reshape(0, 1)
