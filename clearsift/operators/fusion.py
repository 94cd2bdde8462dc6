"""Reciprocal rank fusion of ranked lists held as long tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearsift.constants import RRF_K


def rrf_scores(
    rankings: DataFrame, keys, id_col: str, k: int = RRF_K, dense: bool = False
) -> DataFrame:
    """Score every candidate of each fused group.

    ``rankings`` has the group keys, ``list_no``, ``pos`` and the candidate id.
    A score sums ``1 / (k + rank)`` with ranks from 0; a repeat inside a list
    counts once and takes no rank.  ``dense`` states that lists hold no repeats
    and positions are 0, 1, 2, ..., which saves the renumbering.
    """
    if k <= 0:
        raise ValueError(f"k must be positive: {k}")
    keys = list(keys)
    if dense:
        ranked = rankings.withColumn("place", F.col("pos"))
    else:
        by_position = Window.partitionBy(*keys, "list_no").orderBy("pos", id_col)
        ranked = (
            rankings.groupBy(*keys, "list_no", id_col)
            .agg(F.min("pos").alias("pos"))
            .withColumn("place", F.row_number().over(by_position) - 1)
        )
    parts = F.sort_array(
        F.collect_list(F.struct("list_no", (F.lit(1.0) / (F.lit(k) + F.col("place"))).alias("s")))
    )
    return ranked.groupBy(*keys, id_col).agg(
        F.aggregate(parts, F.lit(0.0), lambda total, part: total + part["s"]).alias("score"),
        F.min(F.struct("list_no", "pos")).alias("first_seen"),
    )


def rrf(
    rankings: DataFrame, keys, id_col: str, k: int = RRF_K, dense: bool = False
) -> DataFrame:
    """Fused order as 1-based ``rank``: score first, then first appearance."""
    keys = list(keys)
    best_first = Window.partitionBy(*keys).orderBy(
        F.col("score").desc(), "first_seen", id_col
    )
    return (
        rrf_scores(rankings, keys, id_col, k, dense)
        .withColumn("rank", F.row_number().over(best_first))
        .drop("first_seen")
    )
