"""Access records, their reports, and the document catalogue."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.access import masked_query, null_as_open
from clearsift.functions.scale import broadcast_if_small, top_k
from clearsift.schema import RECORD_COLUMNS

CATALOGUE_COLUMNS = [
    "document_id",
    "title",
    "doc_type",
    "required_clearance",
    "allowed_departments",
    "source_path",
    "chunk_count",
]


def hit_records(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """One allowed record per chunk handed out; ids and codes, never text."""
    asked = requests.select(
        "request_id", "ts", "persona", "department", "clearance", "query", "session_id"
    )
    return (
        hits.select("request_id", "clause_code", F.col("chunk_id").alias("resource_id"))
        .join(asked, "request_id")
        .withColumn("resource_kind", F.lit("chunk"))
        .withColumn("allowed", F.lit(True))
        .select(*RECORD_COLUMNS)
    )


def violation_records(violations: DataFrame, requests: DataFrame) -> DataFrame:
    """One blocked record per id outside its request's scope."""
    asked = requests.select(
        "request_id", "ts", "persona", "department", "clearance", "query", "session_id"
    )
    return (
        violations.select("request_id", "resource_kind", "resource_id")
        .join(asked, "request_id")
        .withColumn("clause_code", F.lit(None).cast("string"))
        .withColumn("allowed", F.lit(False))
        .select(*RECORD_COLUMNS)
    )


def recent(records: DataFrame, limit: int = C.DEFAULT_ACCESS_LIMIT, session: str = "") -> DataFrame:
    """Newest records with other sessions' queries masked."""
    if not 1 <= limit <= C.MAX_ACCESS_LIMIT:
        raise ValueError(f"limit must be within 1..{C.MAX_ACCESS_LIMIT}: {limit}")
    shown = masked_query(F.col("query"), F.col("session_id"), F.lit(session or ""))
    return (
        records.orderBy(F.col("ts").desc(), F.col("record_id").desc())
        .limit(limit)
        .withColumn("query", shown)
    )


def blocked(
    records: DataFrame, limit: int = C.DEFAULT_VIOLATION_LIMIT, session: str = ""
) -> DataFrame:
    """Newest blocked records."""
    return recent(records.where(~F.col("allowed")), limit, session)


def catalogue(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunk counts, zero included, by source path."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return (
        documents.withColumn("allowed_departments", null_as_open("allowed_departments"))
        .join(counts, "document_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        .select(*CATALOGUE_COLUMNS)
        .orderBy("source_path")
    )


def principals_by_rank(principals: DataFrame) -> DataFrame:
    return principals.select("name", "department", "clearance", "role").orderBy(
        "clearance", "name"
    )


def catalogue_totals(listing: DataFrame, doc_type: str) -> DataFrame:
    return listing.agg(
        F.count("*").alias("documents"),
        F.sum("chunk_count").alias("chunks"),
        F.count_if(F.col("doc_type") == doc_type).alias(f"{doc_type}_documents"),
    )


def dashboard(records: DataFrame) -> DataFrame:
    """Questions asked, documents read and requests blocked, over all records.

    A question is a distinct (query, persona, time); only chunk records count
    as documents, since log ids overlap with chunk ids.
    """
    return records.agg(
        F.count_distinct(F.struct("query", "persona", "ts")).alias("queries"),
        F.count_distinct(F.when(F.col("resource_kind") == "chunk", F.col("resource_id"))).alias(
            "chunks_read"
        ),
        F.count_if(~F.col("allowed")).alias("blocked"),
    )


def dashboard_latest(records: DataFrame, limit: int = C.MAX_ACCESS_LIMIT) -> DataFrame:
    """The tiles as shown: over the newest records, flagged when cut short."""
    latest = records.orderBy(F.col("ts").desc(), F.col("record_id").desc()).limit(limit)
    newest_blocked = (
        records.where(~F.col("allowed"))
        .orderBy(F.col("ts").desc(), F.col("record_id").desc())
        .limit(limit)
    )
    blocked_tiles = newest_blocked.agg(
        F.count("*").alias("blocked"), (F.count("*") >= limit).alias("blocked_truncated")
    ).withColumn("tile", F.lit(1))
    read_tiles = latest.agg(
        F.count_distinct(F.struct("query", "persona", "ts")).alias("queries"),
        F.count_distinct(F.when(F.col("resource_kind") == "chunk", F.col("resource_id"))).alias(
            "chunks_read"
        ),
        (F.count("*") >= limit).alias("truncated"),
    ).withColumn("tile", F.lit(1))
    return read_tiles.join(blocked_tiles, "tile").drop("tile")


def filtered(records: DataFrame, blocked_only: bool = False, persona: str | None = None):
    """The record table under its filters."""
    if blocked_only:
        return records.where(~F.col("allowed"))
    return records if persona is None else records.where(F.col("persona") == persona)


def personas(records: DataFrame) -> DataFrame:
    """Personas that occur, with their record counts."""
    return records.groupBy("persona").agg(
        F.count("*").alias("records"), F.count_if(~F.col("allowed")).alias("blocked")
    )


def daily_quota(
    requests: DataFrame, exempt: DataFrame, limit: int = C.DAILY_QUOTA
) -> DataFrame:
    """Allowed flag and remaining count of every request, per user and UTC day.

    ``requests``: request_id, user, ts.  Users in ``exempt`` are never limited
    (remaining is null).  Only the first ``limit`` requests of a user's day are
    ever ranked; all later ones are past the day's last allowed request, so a
    user sending most of the traffic does not collect in one task.
    """
    free = exempt.select("user", F.lit(True).alias("exempt"))
    dated = requests.select("request_id", "user", "ts", F.to_date("ts").alias("day")).join(
        broadcast_if_small(free), "user", "left"
    )
    limited = dated.where(F.col("exempt").isNull())
    first = top_k(limited, ["user", "day"], ["ts", "request_id"], limit, "n")
    used = first.select("request_id", "user", "day", "ts", "n")
    last_allowed = used.where(F.col("n") == limit).select(
        "user", "day", F.struct("ts", "request_id").alias("last_allowed")
    )
    later = limited.join(broadcast_if_small(last_allowed), ["user", "day"]).where(
        F.struct("ts", "request_id") > F.col("last_allowed")
    )
    columns = ["request_id", "user", "day"]
    return (
        used.select(*columns, F.lit(True).alias("allowed"), (limit - F.col("n")).alias("remaining"))
        .unionByName(
            later.select(*columns, F.lit(False).alias("allowed"), F.lit(0).alias("remaining"))
        )
        .unionByName(
            dated.where(F.col("exempt")).select(
                *columns,
                F.lit(True).alias("allowed"),
                F.lit(None).cast("int").alias("remaining"),
            )
        )
    )
