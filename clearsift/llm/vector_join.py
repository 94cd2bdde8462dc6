"""Exact top-k search by inner product as a Voronoi kNN join.

One more coordinate, ``sqrt(M^2 - |x|^2)`` for data and 0 for queries, which are
stretched to length M, makes the greatest inner product the least Euclidean
distance, so triangle inequalities bound it.  Data and queries go to the cell of their nearest pivot.  Summaries of
the cells (radius, distances of the members nearest to the pivot) give a
distance within which every query of a group of cells has its answer, and from
that the ring of each cell that may hold one.  Only rows in these rings are sent
to a group; there, blocks of queries meet blocks of data cell by cell.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.functions.scale import cut, top_k
from clearsift.llm.batches import small_batches

SCALE = 256
PIVOTS = 256
GROUPS = 32
QUERY_BLOCK = 512
DATA_BLOCK = 8192
#: Scores stay 64-bit numbers while squared lengths stay below this.
LONGEST = 2**62
#: Slack of distances, against rounding, as a share of the longest one.
SLACK = 1e-6


def scaled(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``id``, ``vector``: components as ``floor(scale * x)``, 32-bit numbers.

    Rows with a null id, a null vector, or a null or not finite component take
    no part, nor do vectors of a squared length of 2^62 or more.  Components a
    shorter vector lacks count as 0.
    """
    schema = T.StructType(
        [T.StructField("id", vectors.schema[id_col].dataType), T.StructField("vector", T.BinaryType())]
    )

    def quantize(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            flat = lists.flatten().cast("float64")
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * flat.to_numpy(zero_copy_only=False))
            small = np.abs(whole) < 2.0**31
            whole = np.where(small, whole, 0)
            squares = np.bincount(row, np.square(whole), len(sizes))
            good = (np.bincount(row, ~small, len(sizes)) == 0) & (squares < LONGEST)
            whole = whole.astype("<i4")
            keep = np.flatnonzero(good)
            packed = [
                np.trim_zeros(whole[e - n : e], "b").tobytes()
                for e, n in zip(ends[keep].tolist(), sizes[keep].tolist())
            ]
            ids = batch.column(0).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, "binary")], names=schema.names)

    given = small_batches(vectors).select(id_col, vector_col)
    return given.dropna().mapInArrow(quantize, schema)


def matrix(column, dim: int | None = None) -> np.ndarray:
    """Packed vectors as rows of exact 64-bit floats, padded with zeros."""
    parts = [np.frombuffer(x.as_buffer(), dtype="<i4") for x in column]
    dim = max([1, *map(len, parts)]) if dim is None else dim
    out = np.zeros((len(parts), dim))
    for row, part in zip(out, parts):
        row[: len(part)] = part
    return out


def products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers."""
    longest = [np.sqrt(np.square(x).sum(axis=1).max(initial=0)) for x in (one, other)]
    if longest[0] * longest[1] < 2.0**52:
        return (one @ other.T).astype(np.int64)
    return one.astype(np.int64) @ other.T.astype(np.int64)


class Space:
    """Pivots in the space where nearest means greatest inner product."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.square, self.dim = longest, pivots.shape[1]
        self.pivots = np.c_[pivots, self._more(pivots)]
        self.slack = SLACK * max(1.0, 2 * np.sqrt(longest))

    def _more(self, rows):
        return np.sqrt(np.maximum(self.square - np.square(rows).sum(axis=1), 0))

    def distances(self, rows: np.ndarray, data: bool) -> np.ndarray:
        """Of data rows or queries to all pivots."""
        if data:
            full = np.c_[rows, self._more(rows)]
        else:
            full = np.c_[rows * self._stretch(rows)[:, None], np.zeros(len(rows))]
        squares = np.square(full).sum(axis=1)[:, None] + np.square(self.pivots).sum(axis=1)
        return np.sqrt(np.maximum(squares - 2 * full @ self.pivots.T, 0))

    def _stretch(self, queries):
        lengths = np.sqrt(np.square(queries).sum(axis=1))
        return np.sqrt(self.square) / np.where(lengths > 0, lengths, 1)

    def between(self) -> np.ndarray:
        gaps = self.pivots[:, None, :] - self.pivots[None, :, :]
        return np.sqrt(np.square(gaps).sum(axis=2))

    def bound(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which data has this inner product with each query."""
        stretch = self._stretch(rows)
        own = np.square(stretch) * np.square(rows).sum(axis=1)
        square = own + self.square - 2.0 * stretch * scores
        return np.sqrt(np.maximum(square, 0))


def _celled(rows: DataFrame, space, data: bool) -> DataFrame:
    """``rows`` with the ``cell`` of the nearest pivot and the ``distance``."""
    schema = T.StructType(
        [*rows.schema, T.StructField("cell", T.LongType()), T.StructField("distance", T.DoubleType())]
    )
    at = rows.columns.index("vector")

    def assign(batches):
        import pyarrow as pa

        places = space.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = places.distances(matrix(batch.column(at), places.dim), data)
            cells = found.argmin(axis=1)
            columns = [pa.array(cells), pa.array(found[np.arange(len(cells)), cells])]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, names=schema.names)

    return rows.mapInArrow(assign, schema)


def _groups(cells: dict, between: np.ndarray, groups: int) -> dict:
    """Cells of queries in groups of near pivots: seeds far from each other,
    then each cell to the seed whose group is near and not full.  ``cells`` has
    the number of queries of each cell."""
    names = sorted(cells, key=lambda c: (-cells[c], c))
    seeds = names[:1]
    nearest = between[seeds[0], names] if names else np.zeros(0)
    while len(seeds) < min(groups, len(names)):
        far = names[int(nearest.argmax())]
        if nearest.max() <= 0:
            break
        seeds.append(far)
        nearest = np.minimum(nearest, between[far, names])
    return {c: int(between[c, seeds].argmin()) for c in names}


def _rings(summary, radius: dict, group_of: dict, between: np.ndarray, k: int, slack: float):
    """``group``, ``cell``, ``low``, ``high``: distances to a cell's pivot at
    which a member may be among the ``k`` nearest of a query of the group, and
    ``reach``, the bound of each group."""
    cells = np.array([row["cell"] for row in summary], dtype=np.int64)
    nearest = [(row["cell"], d) for row in summary for d in row["nearest"]]
    member_of = np.array([c for c, _ in nearest], dtype=np.int64)
    members = np.array([d for _, d in nearest])
    low, high, reach = {}, {}, {}
    for own, group in group_of.items():
        r = radius[own]
        # The k-th least of these bounds the k-th distance of all its queries.
        upper = np.sort(r + between[own, member_of] + members)
        theta = upper[k - 1] if len(upper) >= k else np.inf
        reach[group] = max(reach.get(group, 0.0), theta + slack)
        for cell, gap in zip(cells.tolist(), between[own, cells].tolist()):
            key = (group, cell)
            low[key] = min(low.get(key, np.inf), gap - r - theta - slack)
            high[key] = max(high.get(key, -np.inf), gap + r + theta + slack)
    return [(g, c, float(low[g, c]), float(high[g, c])) for g, c in low], reach


def top_k_join(
    queries: DataFrame,
    data: DataFrame,
    k: int = 5,
    pivots: int = PIVOTS,
    groups: int = GROUPS,
    query_block: int = QUERY_BLOCK,
    data_block: int = DATA_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``score``: for each query the
    ``k`` rows of greatest inner product (all, if fewer), equal scores by
    ascending id.  Both inputs are ``id``, ``vector`` as ``scaled`` gives them.

    A row is no candidate of queries of its own id.  Rows of one id and vector
    count once; rows of one id and other vectors are candidates each, and
    queries each.  Empty tables give no rows; other columns are left out.

    Equal vectors are one point with its ``k + 1`` smallest ids, as no other can
    be an answer.  Pivots are the ``pivots`` points of smallest hash; whichever
    they are, the result is exact.  The driver gets pivots and one summary for
    each cell.  A crowded cell is dealt to its groups in blocks by hash.
    """
    small_batches(data)
    spark = data.sparkSession
    wide = k + 1  # the query's own row may be among them
    id_type = data.schema["id"].dataType
    points = top_k(data.select("id", "vector").distinct(), ["vector"], [F.asc("id")], wide)
    points = points.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = cut(points)
    asked = cut(
        queries.select("vector").distinct().withColumn("query", F.monotonically_increasing_id())
    )
    none = T.StructType(
        [
            T.StructField("query_id", queries.schema["id"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("score", T.LongType()),
        ]
    )
    chosen = (
        points.orderBy(F.xxhash64("vector"), "vector").limit(pivots).select("vector").toArrow()
    )
    if not chosen.num_rows or asked.isEmpty():
        return spark.createDataFrame([], none)
    dim, longest = _extent(points.select("vector").union(asked.select("vector")))
    centres = matrix(chosen.column("vector"), dim)
    space = Space(np.unique(centres, axis=0), longest)
    shared = spark.sparkContext.broadcast(space)

    points = cut(_celled(points, shared, data=True))
    asked = cut(_celled(asked, shared, data=False))
    summary = (
        top_k(points.select("cell", "distance"), ["cell"], [F.asc("distance")], wide)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("distance")).alias("nearest"))
        .join(points.groupBy("cell").agg(F.max("distance").alias("radius")), "cell")
        .collect()
    )
    crowd = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()
    between = space.between()
    group_of = _groups({row["cell"]: row["n"] for row in crowd}, between, groups)
    radius = {row["cell"]: row["r"] for row in crowd}
    rings, reach = _rings(summary, radius, group_of, between, wide, space.slack)

    # Bounded by cells x groups, whatever the data.
    rings = F.broadcast(spark.createDataFrame(rings, "group long, cell long, low double, high double"))
    sent = points.join(rings, "cell").where("distance BETWEEN low AND high").drop("low", "high")
    many = {row["group"]: row["count"] for row in sent.groupBy("group").count().collect()}
    asked_of = {}
    for row in crowd:
        asked_of[group_of[row["cell"]]] = asked_of.get(group_of[row["cell"]], 0) + row["n"]
    blocks = [
        (g, -(-asked_of[g] // query_block), -(-n // data_block)) for g, n in many.items()
    ]
    blocks = F.broadcast(spark.createDataFrame(blocks, "group long, query_blocks long, data_blocks long"))
    homes = F.broadcast(spark.createDataFrame(list(group_of.items()), "cell long, group long"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = (
        asked.join(homes, "cell")
        .join(blocks, "group")
        .withColumn("query_part", F.pmod(F.xxhash64("vector"), F.col("query_blocks")))
        .withColumn("data_part", every("data_blocks"))
        .select("group", "query_part", "data_part", "query", "vector")
    )
    theirs = (
        sent.join(blocks, "group")
        .withColumn("data_part", F.pmod(F.xxhash64("vector"), F.col("data_blocks")))
        .withColumn("query_part", every("query_blocks"))
        .select("group", "query_part", "data_part", "cell", "distance", "vector", "ids")
    )
    keys = ["group", "query_part", "data_part"]
    solved = T.StructType(
        [T.StructField("query", T.LongType()), T.StructField("score", T.LongType())]
        + [T.StructField("id", id_type)]
    )

    def solve(own, other):
        return _solved(own, other, shared.value, reach, wide)

    pairs = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(solve, solved)
    order = [F.desc("score"), F.asc("id")]
    best = top_k(pairs, ["query"], order, wide, "place").groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("best")
    )
    best = best.join(asked.select("query", "vector"), "query").select("vector", "best")
    rows = queries.select(F.col("id").alias("query_id"), "vector").distinct().join(best, "vector")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("hit.id").alias("id"),
        F.col("hit.score").alias("score"),
    )


def _extent(vectors: DataFrame):
    """Most components and greatest squared length of packed vectors."""

    def extent(batches):
        import pyarrow as pa

        dim, longest = 1, 0.0
        for batch in batches:
            rows = matrix(batch.column(0))
            dim = max(dim, rows.shape[1])
            longest = max(longest, float(np.square(rows).sum(axis=1).max(initial=0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim]), pa.array([longest])], names=["dim", "longest"]
        )

    found = vectors.mapInArrow(extent, "dim long, longest double")
    dim, longest = found.agg(F.max("dim"), F.max("longest")).first()
    return dim, longest


def _solved(own, other, space: Space, reach: dict, k: int):
    """The ``k`` best members of a block of data for each query of a block."""
    import pyarrow as pa

    names = ["query", "score", "id"]
    if not own.num_rows or not other.num_rows:
        ids = other.column("ids").type.value_type
        return pa.table([pa.array([], "int64"), pa.array([], "int64"), pa.array([], ids)], names=names)
    other = other.sort_by("cell").combine_chunks()
    rows = matrix(own.column("vector"), space.dim)
    cells = other.column("cell").to_numpy()
    lists = other.column("ids").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    rank = np.empty(len(flat), dtype=np.int64)
    rank[pa.compute.sort_indices(flat).to_numpy()] = np.arange(len(flat))
    stops = np.cumsum(sizes)
    away = space.distances(rows, data=False)
    edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    distances = other.column("distance").to_numpy()
    spans = []
    for i, j in zip(edges[:-1], edges[1:]):
        gap = away[:, cells[i]]
        least = np.maximum(gap - distances[i:j].max(), distances[i:j].min() - gap)
        spans.append((float(least.min()), i, j, least))
    limit = np.full(len(rows), reach[own.column("group")[0].as_py()])
    held = [(np.zeros(0, np.int64),) * 3]
    for _, i, j, least in sorted(spans, key=lambda s: s[:3]):
        active = np.flatnonzero(least <= limit + space.slack)
        if not len(active):
            continue
        data = matrix(other.column("vector").slice(i, j - i), space.dim)
        scores = np.repeat(products(rows[active], data), sizes[i:j], axis=1)
        places = np.arange(stops[i] - sizes[i], stops[j - 1])
        if scores.shape[1] > k:
            floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            at, column = np.nonzero(scores >= floor[:, None])
        else:
            at, column = np.nonzero(np.ones(scores.shape, dtype=bool))
        held.append((active[at], scores[at, column], places[column]))
        one, score, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((rank[place], -score, one))
        one, score, place = one[order], score[order], place[order]
        here = np.arange(len(one))
        nth = here - np.maximum.accumulate(np.where(np.r_[True, one[1:] != one[:-1]], here, 0))
        last = nth == k - 1
        limit[one[last]] = np.minimum(limit[one[last]], space.bound(rows[one[last]], score[last]))
        keep = nth < k
        held = [(one[keep], score[keep], place[keep])]
    one, score, place = held[0]
    queries = own.column("query").combine_chunks().take(pa.array(one))
    return pa.table([queries, pa.array(score), flat.take(pa.array(place))], names=names)
