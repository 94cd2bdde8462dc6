"""Loading many documents in one job."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.scale import cut, discard
from clearsift.operators.embedding import encode, wrong_dimension
from clearsift.operators.parsing import chunk_rows, clause_rows, parse_files
from clearsift.schema import CHUNKS, CLAUSES, DOCUMENTS
from clearsift.sources.store import Store
from clearsift.sources.tables import (
    clause_ids,
    latest,
    next_id,
    numbered,
    replace_chunks,
    require_paired,
    upsert_clauses,
    upsert_documents,
)

CHUNK_COLUMNS = ["chunk_id", "document_id", "clause_id", "ordinal", "text", "embedding"]
# Tables of a store, and the column that decides where a row lies.
STORED = {"documents": "source_path", "clauses": "document_id", "chunks": "document_id"}


def ingest(
    files: DataFrame,
    documents: DataFrame,
    clauses: DataFrame,
    chunks: DataFrame,
    encoder,
    dim: int = C.EMBEDDING_DIM,
    batch_size: int = C.ENCODE_BATCH,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, clauses, chunks, report) after loading ``files``.

    ``files`` has path and content, and permission columns for paged text.  A
    document with the same path is replaced: permissions overwritten, chunks
    exchanged, ids kept.  Of several files with one path the last ``modified``
    is loaded, where that column is given, and of those the greatest content.
    New rows get dense ids behind the greatest stored.  The caller stores the
    three tables; ``ingest_into`` does both for a store.
    """
    merged, loaded = load_documents(files, documents)
    more, pieces, report, _ = load_parts(loaded, clauses, chunks, encoder, dim, batch_size)
    return merged, more, pieces, report


def load_documents(
    files: DataFrame, documents: DataFrame, first_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The documents after loading ``files``, and the parsed files with their id."""
    return merge_documents(parsed_files(files), documents, first_id)


def parsed_files(files: DataFrame) -> DataFrame:
    """One parsed row per path, stored.  The files are stored first, as each way
    of parsing and each refusal would read them all again."""
    order = [F.col("modified")] if "modified" in files.columns else []
    files = latest(
        files.withColumn("__order", F.struct(*order, F.md5("content"))), ["path"], "__order"
    ).drop("__order", "modified")
    files = cut(files)
    parsed = cut(parse_files(files).withColumn("loaded", F.lit(1)))
    discard(files)
    return parsed


def merge_documents(
    parsed: DataFrame, documents: DataFrame, first_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """As ``load_documents``, for ``parsed_files``, which are not kept."""
    merged = cut(
        upsert_documents(
            documents,
            parsed.select(
                F.col("path").alias("source_path"),
                "title",
                "doc_type",
                "required_clearance",
                "allowed_departments",
                F.current_timestamp().alias("ingested_at"),
                "loaded",
            ),
            "loaded",
            first_id,
        )
    )
    ids = merged.select("document_id", F.col("source_path").alias("path"))
    loaded = cut(parsed.join(ids, "path"))
    discard(parsed)
    return merged, loaded


def load_parts(
    loaded: DataFrame,
    clauses: DataFrame,
    chunks: DataFrame,
    encoder,
    dim: int = C.EMBEDDING_DIM,
    batch_size: int = C.ENCODE_BATCH,
    first_ids: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """Clauses and chunks after loading these documents, the report, and the next
    free ids.  Chunks and vectors are counted where they are made; if they do not
    pair up nothing is handed on."""
    first = first_ids or {
        "clauses": next_id(clauses, "clause_id"), "chunks": next_id(chunks, "chunk_id"),
    }
    rows = clause_rows(loaded)
    # Texts are stored once on their way to a clause and once with their vectors.
    merged_clauses = upsert_clauses(
        clauses, rows.withColumnRenamed("position", "n"), "n", first_id=first["clauses"]
    )
    pieces = chunk_rows(
        rows.join(clause_ids(merged_clauses), ["document_id", "code"]).select(
            "document_id", "clause_id", "position", "text"
        )
    )
    made, given = Observation(), Observation()
    many = F.count(F.lit(1)).alias("n")
    encoded = cut(
        encode(
            pieces.observe(made, many).withColumn("__encode", F.col("text")),
            "__encode",
            "passage",
            encoder,
            dim,
            batch_size,
        ).observe(given, many, F.count("embedding").alias("vectors"))
    )
    if not made.get["n"] == given.get["n"] == given.get["vectors"]:
        require_paired(pieces, encoded.where("embedding IS NOT NULL"))
    if not wrong_dimension(encoded, dim).isEmpty():
        raise ValueError(f"vectors must have {dim} elements")
    encoded, free = numbered(encoded, "chunk_id", first["chunks"], stored=True)
    merged_chunks = replace_chunks(chunks, encoded.select(*CHUNK_COLUMNS), loaded)
    counted = (
        loaded.select("document_id", F.size("clauses").alias("clauses"))
        .join(
            encoded.groupBy("document_id").agg(F.count("*").alias("chunks")), "document_id", "left"
        )
        .select("document_id", "clauses", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    )
    after = {"clauses": next_id(merged_clauses, "clause_id"), "chunks": free}
    after["clauses"] = max(after["clauses"], first["clauses"])
    return merged_clauses, merged_chunks, counted, after


def store_at(spark: SparkSession, root: str, **options) -> Store:
    """The store of a corpus."""
    return Store(spark, root, STORED, **options)


def ingest_into(store: Store, files: DataFrame, encoder, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """Load ``files`` into a store and publish the result; returns the report.

    Only the buckets of the loaded documents are read and written again, and ids
    go on from the manifest, so a small load costs as much in a large corpus as
    in a small one.  Raises ``Conflict`` if someone else published meanwhile.
    """
    version = store.manifest()
    ids = version["next_ids"]
    parsed = parsed_files(files)
    places = {"documents": store.buckets_of(parsed, "path")}
    documents = store.read("documents", version, places["documents"], DOCUMENTS)
    first = ids.get("documents", 1)
    merged, loaded = merge_documents(parsed, documents, first)
    places["clauses"] = places["chunks"] = store.buckets_of(loaded, "document_id")
    clauses, chunks, report, after = load_parts(
        loaded,
        store.read("clauses", version, places["clauses"], CLAUSES),
        store.read("chunks", version, places["chunks"], CHUNKS),
        encoder,
        dim,
        first_ids={"clauses": ids.get("clauses", 1), "chunks": ids.get("chunks", 1)},
    )
    after["documents"] = max(first, next_id(merged, "document_id"))
    tables = {"documents": merged, "clauses": clauses, "chunks": chunks}
    store.publish(version, tables, places, after)
    return report
