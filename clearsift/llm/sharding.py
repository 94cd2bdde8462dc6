"""Rendezvous hashing of stable record keys over weighted shards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clearsift.functions.scale import cut


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score ``-weight / ln(u)`` for the key, where
    ``u`` in (0, 1) is a hash of key and shard.  A new last shard takes keys
    only into itself; a changed weight moves keys only from or to that shard.
    A null key is the empty key."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def score(i: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f"#{i}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("s"), F.lit(-i).alias("i"))

    scores = [score(i, w) for i, w in enumerate(weights) if w > 0]
    best = F.array_max(F.array(*scores))
    return (-best["i"]).cast("int")


def shard(
    docs: DataFrame,
    shards: int = 16,
    weights: list[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row's shard and its gapless slot there.

    Gives the id, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``,
    ``shard``, ``slot`` and ``grown_shard`` (with one more shard of the mean
    weight).  Null texts have no bytes; rows of one key, null too, share a shard
    and have slots of their own; other columns are left out.

    Slots follow the input: each scan task's rows of a shard are numbered, and
    start behind those of the tasks before it, so no key or shard is gathered.
    The narrow rows are written once, so both passes see the same tasks.
    """
    weights = list(weights or [1.0] * shards)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    grown = [*weights, sum(weights) / len(weights)]
    rows = cut(
        docs.select(
            F.col(id_col),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            shard_of(F.col(id_col), weights).alias("shard"),
            shard_of(F.col(id_col), grown).alias("grown_shard"),
            F.monotonically_increasing_id().alias("__row"),
        ).withColumn("__task", F.shiftright("__row", 33))
    )
    earlier = Window.partitionBy("shard").orderBy("__task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = rows.groupBy("shard", "__task").count().select(
        "shard", "__task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__start")
    )
    within = Window.partitionBy("shard", "__task").orderBy("__row")
    return (
        rows.withColumn("__at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "__task"])
        .select(
            id_col, "size", "text_crc32", "shard",
            (F.col("__start") + F.col("__at")).alias("slot"), "grown_shard",
        )
    )
