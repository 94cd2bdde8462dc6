"""The distinct searches behind a batch of requests."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsift.functions.scale import collected, local, settle
from clearsift.operators.entitlements import class_sets, principal_classes

# Searches are sent to every task only up to these bounds: queries, numbers in
# their vectors, and rows that a task may hold as the best of all its searches.
BROADCAST_QUERIES = 20_000
BROADCAST_CELLS = 16_000_000
BEST_ROWS = 2_000_000
_PAIR = ["query_id", "class_key", "department", "clearance"]


@dataclass
class Searches:
    """Requests that share a query and a class are one search.

    ``queries`` has a row for each query asked, with ``class_keys``; as Arrow in
    ``table`` when they are few, else None.  ``pairs`` is the number of searches,
    where that is known, as then are their ``class_keys``.  ``sets`` says which
    classes may see a signature.
    """

    queries: DataFrame
    table: pa.Table | None
    pairs: int | None
    sets: DataFrame | None
    class_keys: list[str] | None = None

    def bound(self, k: int) -> int | None:
        """Rows of a result with ``k`` rows for each search, if known."""
        return None if self.pairs is None else k * self.pairs


def searches_of(
    requests: DataFrame, queries: DataFrame, k: int, permissions: DataFrame | None, *columns
) -> Searches:
    """The searches of ``requests`` for ``k`` rows each, with these columns of
    ``queries``.  Sizes are bounded in rows before anything is collected.  Class
    sets are computed here, once, for all that search; without ``permissions``
    there are none."""
    spark = requests.sparkSession
    asked = requests.select(*_PAIR).distinct()
    grouped = asked.groupBy("query_id").agg(F.collect_set("class_key").alias("class_keys"))
    wanted = queries.select("query_id", *columns)
    rows = wanted.join(grouped, "query_id")
    pairs = collected(asked, BEST_ROWS // k)
    classes, sets = principal_classes(requests), None
    if pairs is not None:
        found = pairs.group_by(["department", "clearance", "class_key"]).aggregate([])
        classes = local(spark, found, classes.select("department", "clearance", "class_key").schema)
    if permissions is not None:
        sets = settle(class_sets(permissions, classes))
    if pairs is None:
        return Searches(rows, None, None, sets)
    keys = {}
    for query, key in zip(pairs["query_id"].to_pylist(), pairs["class_key"].to_pylist()):
        keys.setdefault(query, {})[key] = None
    many = sum(map(len, keys.values()))
    known = sorted({key for found in keys.values() for key in found})
    schema = requests.select("query_id").schema
    ids = pa.table({"query_id": pa.array(list(keys), pairs.schema.field("query_id").type)})
    wanted = wanted.join(F.broadcast(local(spark, ids, schema)), "query_id", "left_semi")
    table = collected(wanted, BROADCAST_QUERIES)
    if table is None:
        return Searches(rows, None, many, sets, known)
    lists = pa.array([list(keys[q]) for q in table["query_id"].to_pylist()], pa.list_(pa.string()))
    return Searches(rows, table.append_column("class_keys", lists), many, sets, known)
