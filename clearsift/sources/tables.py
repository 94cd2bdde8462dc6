"""Stored tables as snapshots: merges are pure DataFrame functions, and a new
snapshot is written beside the old one, which stays readable until then."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.functions.access import access_keys, open_as_null, signature
from clearsift.functions.scale import broadcast_if_small, cut
from clearsift.schema import DOC_TYPES, RECORD_COLUMNS, SIGNATURE


class CountMismatch(Exception):
    """Chunks and vectors do not pair up; ``rows`` has every document concerned."""

    def __init__(self, count: int, rows: DataFrame):
        super().__init__(f"{count} documents with unequal numbers of chunks and vectors")
        self.rows = rows


class IdCollision(Exception):
    """Two keys hash to one surrogate id."""


# ------------------------------------------------------------------ merging


def latest(incoming: DataFrame, keys, order_col: str) -> DataFrame:
    """One row per key, the last by ``order_col``; repeats combine map-side."""
    keys = list(keys)
    rest = [c for c in incoming.columns if c not in keys]
    return (
        incoming.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("row"))
        .select(*keys, "row.*")
    )


def numbered(
    rows: DataFrame, id_col: str, first: int, stored: bool = False
) -> tuple[DataFrame, int]:
    """``rows`` with dense ids from ``first``, and the next free id.

    Every partition counts its rows, and its ids follow those of the partitions
    before it, so nothing is gathered and no two rows can get one id.  Rows are
    stored first, unless they are ``stored``: a ``cut``, or some rows of one.
    """
    rows = rows if stored else cut(rows)
    place = F.spark_partition_id().alias("__place")
    counts = sorted(rows.groupBy(place).count().collect())
    starts, free = [], first
    for at, many in counts:
        starts.append((at, free))
        free += many
    if free >= 1 << 63:
        raise OverflowError("ids are used up")
    starts = rows.sparkSession.createDataFrame(starts, "__place int, __start long")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    found = rows.select("*", place, within.alias("__within")).join(F.broadcast(starts), "__place")
    return (
        found.withColumn(id_col, F.col("__start") + F.col("__within")).drop(
            "__place", "__start", "__within"
        ),
        free,
    )


def next_id(table: DataFrame, id_col: str) -> int:
    """The id behind the greatest one stored."""
    return max(0, (table.agg(F.max(id_col)).first()[0] or 0)) + 1


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys,
    order_col: str,
    id_col: str | None = None,
    first_id: int | None = None,
) -> DataFrame:
    """Insert new keys and overwrite known ones; rows not mentioned stay.

    With ``id_col``, a known key keeps its id and new keys get dense ids from
    ``first_id``, or behind the greatest one in ``existing``.
    """
    keys = list(keys)
    changes = latest(incoming, keys, order_col).drop(order_col)
    if id_col is not None:
        first = next_id(existing, id_col) if first_id is None else first_id
        held = existing.select(*keys, F.col(id_col))
        changes = cut(changes.join(held, keys, "left"))
        unknown = changes.where(F.col(id_col).isNull()).drop(id_col)
        fresh, _ = numbered(unknown, id_col, first, stored=True)
        changes = changes.where(F.col(id_col).isNotNull()).unionByName(fresh)
    kept = existing.join(broadcast_if_small(changes.select(*keys)), keys, "left_anti")
    return kept.unionByName(changes.select(*existing.columns))


def upsert_documents(
    existing: DataFrame, incoming: DataFrame, order_col: str, first_id: int | None = None
) -> DataFrame:
    """By source path: the id stays, title, type and permissions are replaced,
    so that loading a document again reclassifies it."""
    normal = incoming.withColumn("allowed_departments", open_as_null("allowed_departments"))
    strange = normal.where(~F.col("doc_type").isin(*DOC_TYPES)).select("doc_type").limit(1).collect()
    if strange:
        raise ValueError(f"unknown document type: {strange[0].doc_type}")
    return upsert(existing, normal, ["source_path"], order_col, "document_id", first_id)


def upsert_clauses(
    existing: DataFrame,
    incoming: DataFrame,
    order_col: str,
    prune: bool = False,
    first_id: int | None = None,
) -> DataFrame:
    """By (document, code).  Codes that vanished stay unless ``prune`` is set."""
    merged = upsert(existing, incoming, ["document_id", "code"], order_col, "clause_id", first_id)
    if not prune:
        return merged
    reloaded = incoming.select("document_id").distinct()
    present = incoming.select("document_id", "code").distinct()
    untouched = merged.join(broadcast_if_small(reloaded), "document_id", "left_anti")
    return untouched.unionByName(merged.join(present, ["document_id", "code"], "left_semi"))


def clause_ids(clauses: DataFrame) -> DataFrame:
    return clauses.select("document_id", "code", "clause_id")


def upsert_hosts(existing: DataFrame, incoming: DataFrame, order_col: str) -> DataFrame:
    normal = incoming.withColumn("allowed_departments", open_as_null("allowed_departments"))
    return upsert(existing, normal, ["name"], order_col)


def host_names(hosts: DataFrame) -> DataFrame:
    return hosts.select("name").distinct()


def upsert_principals(existing: DataFrame, incoming: DataFrame, order_col: str) -> DataFrame:
    return upsert(existing, incoming, ["name"], order_col)


def replace_chunks(existing: DataFrame, incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunks of the reloaded ``documents`` give way to ``incoming`` at once,
    so loading twice changes nothing."""
    reloaded = documents.select("document_id").distinct()
    kept = existing.join(broadcast_if_small(reloaded), "document_id", "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def unpaired(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents whose chunk and vector counts differ."""
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    v = vectors.groupBy("document_id").agg(F.count("*").alias("vectors"))
    zero = F.lit(0)
    return c.join(v, "document_id", "full").select(
        "document_id",
        F.coalesce("chunks", zero).alias("chunks"),
        F.coalesce("vectors", zero).alias("vectors"),
    ).where(F.col("chunks") != F.col("vectors"))


def require_paired(chunks: DataFrame, vectors: DataFrame) -> None:
    found = cut(unpaired(chunks, vectors))
    count = found.count()
    if count:
        raise CountMismatch(count, found)


def check_ids(table: DataFrame, id_col: str, keys) -> None:
    """Raise when two keys share an id."""
    clash = (
        table.groupBy(id_col)
        .agg(F.count_distinct(*keys).alias("n"))
        .where("n > 1")
        .limit(1)
        .collect()
    )
    if clash:
        raise IdCollision(f"{id_col} {clash[0][0]} stands for several keys")


def delete_documents(
    documents: DataFrame, clauses: DataFrame, chunks: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents without the ``doomed`` ids, and their clauses and chunks."""
    gone = broadcast_if_small(doomed.select("document_id").distinct())
    return tuple(t.join(gone, "document_id", "left_anti") for t in (documents, clauses, chunks))


def corpus_size(chunks: DataFrame) -> int:
    """Chunks stored; for operators, never on a request path."""
    return chunks.count()


# ------------------------------------------------------------------ storing


def write_snapshot(table: DataFrame, root: str, version: str, sort_by=()) -> None:
    """Write one immutable version; it must not exist yet."""
    out = table.sortWithinPartitions(*sort_by) if sort_by else table
    out.write.mode("errorifexists").parquet(f"{root}/version={version}")


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def write_by_signature(rows: DataFrame, path: str) -> None:
    """Store rows with permission columns in a folder for each permission
    signature, so that a search opens only the folders its principals may see.
    For corpora with some thousands of signatures at most."""
    keys = access_keys("allowed_departments")
    keyed = rows.withColumn(SIGNATURE, signature("required_clearance", keys))
    # Rebalancing splits a signature that most rows have.
    keyed.hint("rebalance", SIGNATURE).write.partitionBy(SIGNATURE).parquet(path)


def append_records(records: DataFrame, path: str) -> int:
    """Append access records by day and say how many; none is a no-op."""
    dated = records.select(*RECORD_COLUMNS, F.to_date("ts").alias("dt"))
    counted = records.count()
    if counted:
        dated.write.mode("append").partitionBy("dt").parquet(path)
    return counted
