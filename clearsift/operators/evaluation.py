"""Retrieval quality: recall, MRR and nDCG with binary relevance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsift.constants import DEFAULT_K
from clearsift.functions.scale import cut, top_k


class EmptyCorpus(Exception):
    """There is nothing to search, so scores would be meaningless."""


def unique_top(retrieved: DataFrame, k: int) -> DataFrame:
    """Distinct codes in first-seen order, at most ``k`` per query.

    ``retrieved``: request_id, rank, code (null codes are left out).
    """
    first = (
        retrieved.where(F.col("code").isNotNull())
        .groupBy("request_id", "code")
        .agg(F.min("rank").alias("first_rank"))
    )
    return top_k(first, ["request_id"], ["first_rank"], k, "place").drop("first_rank")


def query_metrics(
    golden: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = DEFAULT_K
) -> DataFrame:
    """recall, mrr and ndcg of every golden query; no hits score zero.

    ``golden``: request_id.  ``relevant``: request_id, code (a long table, so a
    query may have any number of relevant codes).
    """
    relevant = relevant.select("request_id", "code").distinct()
    sizes = relevant.groupBy("request_id").agg(F.count("*").alias("n_relevant"))
    judged = unique_top(retrieved, k).join(relevant, ["request_id", "code"], "left_semi")
    # Places are added in order, so a score never depends on how rows were split.
    gains = F.aggregate(
        F.sort_array(F.collect_list("place")),
        F.lit(0.0),
        lambda total, place: total + F.lit(1.0) / F.log2(place + 1.0),
    )
    found = judged.groupBy("request_id").agg(
        F.count("*").alias("hits"), F.min("place").alias("first_place"), gains.alias("dcg")
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda total, place: total + F.lit(1.0) / F.log2(place + 1.0),
    )
    zero = F.lit(0.0)
    return (
        golden.join(sizes, "request_id", "left")
        .join(found, "request_id", "left")
        .select(
            *golden.columns,
            F.coalesce(F.col("hits") / F.col("n_relevant"), zero).alias("recall"),
            F.coalesce(F.lit(1.0) / F.col("first_place"), zero).alias("mrr"),
            F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
        )
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over queries, median latency, and the latency at the 95% element.

    The 95% element is the one at index ``min(n - 1, int(0.95 n))`` of the sorted
    latencies, not an interpolated percentile.  ``metrics`` has one row per
    golden query, with ``latency_ms`` as measured by the caller.
    """
    sorted_parts = cut(
        metrics.select("latency_ms")
        .repartitionByRange(F.col("latency_ms"))
        .withColumn("part", F.spark_partition_id())
    )
    sizes = sorted_parts.groupBy("part").count().orderBy("part").collect()  # one row a range
    n = sum(r["count"] for r in sizes)
    if n == 0:
        raise EmptyCorpus("no query was evaluated")
    low, high = element(sorted_parts, sizes, (n - 1) // 2), element(sorted_parts, sizes, n // 2)
    return metrics.agg(
        F.count("*").alias("n_queries"),
        F.avg("recall").alias("recall"),
        F.avg("mrr").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
    ).withColumns(
        {
            "p50_ms": F.lit((low + high) / 2),
            "p95_ms": F.lit(element(sorted_parts, sizes, min(n - 1, int(0.95 * n)))),
        }
    )


def element(sorted_parts: DataFrame, sizes, index: int) -> float:
    """The latency at ``index`` of the whole order, read from the one range
    that holds it."""
    for row in sizes:
        if index < row["count"]:
            part = sorted_parts.where(F.col("part") == row["part"])
            return float(part.orderBy("latency_ms").offset(index).first()["latency_ms"])
        index -= row["count"]
    raise IndexError(index)


def report(metrics: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per-query rows from the worst recall up; an empty corpus is refused."""
    if chunks.isEmpty():
        raise EmptyCorpus("the corpus is empty; ingest documents first")
    return metrics.orderBy("recall", "request_id")
