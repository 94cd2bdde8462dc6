"""Connected components of links by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsift.functions.scale import cut

#: Rows of two numbers that may be broadcast, about 16 MB.
BROADCAST_ROWS = 500_000
#: Links that one task solves at once, about 3 MB; more are contracted first.
SOLVED = 200_000


def star_labels(links: DataFrame) -> DataFrame:
    """``node``, ``component``: one step towards components, without a loop.

    Each node takes its smallest neighbour or itself, then that one's choice.
    Nodes of one label are connected; nodes of different labels may be.
    """
    nearest = (
        links.select(F.col("a").alias("node"), F.col("b").alias("near"))
        .union(links.select("b", "a"))
        .groupBy("node")
        .agg(F.least("node", F.min("near")).alias("component"))
    )
    nearest = cut(nearest)
    return nearest.join(
        nearest.select(F.col("node").alias("component"), F.col("component").alias("further")),
        "component",
    ).select("node", F.least("component", "further").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for the nodes of
    ``links`` (``a``, ``b``).

    A round hooks every node to the first of its neighbours and itself, in an
    order by hash that is drawn anew each round, and rewrites the links between
    the nodes hooked to; links within one node go.  So a round leaves a share of
    the nodes, however long their chains are.  When at most ``SOLVED`` links are
    left, whatever their number was, a union-find joins them, and the rounds are
    unrolled from the last, which is the smallest.
    """
    left = _different(links.select("a", "b"))
    rounds = []
    while left.count() > SOLVED:
        hooks = cut(_hooks(left, len(rounds)))
        rounds.append(hooks)
        sized = _sized(hooks)
        left = _different(
            left.join(sized.select(F.col("node").alias("a"), F.col("hook").alias("x")), "a")
            .join(sized.select(F.col("node").alias("b"), F.col("hook").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
    found = _solved(left)
    if not rounds:
        return found.withColumnRenamed("root", "component")
    found = cut(found)
    for hooks in reversed(rounds):
        further = found.select(F.col("node").alias("hook"), "root")
        found = cut(
            hooks.join(_sized(further), "hook", "left").select(
                "node", F.coalesce("root", "hook").alias("root")
            )
        )
    smallest = cut(found.groupBy("root").agg(F.least("root", F.min("node")).alias("component")))
    return found.join(_sized(smallest), "root").select("node", "component")


def _solved(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) of a few links."""

    def solve(batches):
        from pyarrow import RecordBatch, array

        root = {}

        def find(node):
            while root.setdefault(node, node) != node:
                root[node] = node = root[root[node]]
            return node

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield RecordBatch.from_arrays(
            [array(nodes, "int64"), array([find(n) for n in nodes], "int64")], names=["node", "root"]
        )

    return links.coalesce(1).mapInArrow(solve, "node long, root long")


def _different(links: DataFrame) -> DataFrame:
    """Links of two nodes, each once."""
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cut(ordered.where("a <> b").distinct())


def _hooks(links: DataFrame, salt: int) -> DataFrame:
    """``node``, ``hook``: the first of a node and its neighbours in this order."""
    order = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("n"))
    near = links.select(F.col("a").alias("node"), order("b").alias("near")).union(
        links.select("b", order("a"))
    )
    first = near.groupBy("node").agg(F.min("near").alias("near"))
    return first.select("node", F.least("near", order("node"))["n"].alias("hook"))


def _sized(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
