"""Who may see what: joins, rechecks and hydration under entitlements."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.access import (
    access_keys, class_key, principal_keys, signature, visible,
)
from clearsift.functions.scale import broadcast_if_small, cut, settle
from clearsift.schema import SIGNATURE


class AccessViolation(Exception):
    """Rows outside a principal's scope reached an output.

    Carries the kind, their number and ``rows``, a stored table of every request
    and id concerned, to be recorded.  Neither text, title nor host may travel
    through an error.
    """

    def __init__(self, kind: str, rows: DataFrame, count: int):
        super().__init__(f"{count} {kind} rows outside the principal's scope")
        self.kind = kind
        self.rows = rows
        self.count = count


class UnknownPersona(Exception):
    """A request names a persona that does not exist; no name is revealed."""


def principal_classes(principals: DataFrame) -> DataFrame:
    """Distinct (department, clearance) classes; many principals share one."""
    return principals.select(
        "department", "clearance", class_key("department", "clearance").alias("class_key")
    ).distinct()


def class_sets(permissions: DataFrame, classes: DataFrame) -> DataFrame:
    """For each distinct permission signature, the classes that may see it.

    The join form of ``visible``: departments become access keys, so this is an
    equi-join with a clearance residual over signatures, never a nested loop
    over rows.  Signatures nobody may see are absent.
    """
    signatures = permissions.select(
        "required_clearance", access_keys("allowed_departments").alias("access_keys")
    ).distinct()
    keyed_classes = classes.select(
        "class_key", "clearance", F.explode(principal_keys("department")).alias("access_key")
    )
    return (
        signatures.withColumn("access_key", F.explode("access_keys"))
        .join(keyed_classes, "access_key")
        .where(F.col("required_clearance") <= F.col("clearance"))
        .groupBy("required_clearance", "access_keys")
        .agg(F.sort_array(F.collect_set("class_key")).alias("class_keys"))
    )


def with_class_sets(
    rows: DataFrame, classes: DataFrame, permissions: DataFrame | None = None
) -> DataFrame:
    """Attach ``class_keys``, dropping rows no class may see.

    ``permissions`` may name a cheaper table holding the same permission
    columns, so that computed rows are not evaluated twice.
    """
    return with_sets(rows, settle(class_sets(rows if permissions is None else permissions, classes)))


def with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Attach the ``class_keys`` of class sets that are there already.  Rows
    stored by permission signature are read from the folders of signatures that
    some class may see only; the others are not opened."""
    if SIGNATURE in rows.columns:
        seen = sets.select(signature("required_clearance", "access_keys").alias(SIGNATURE)).collect()
        rows = rows.where(F.col(SIGNATURE).isin([r[0] for r in seen])).drop(SIGNATURE)
    keyed = rows.withColumn("access_keys", access_keys("allowed_departments"))
    return keyed.join(sets, ["required_clearance", "access_keys"]).drop("access_keys")


def visible_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per (row, class that may see it)."""
    return with_class_sets(rows, classes).withColumn("class_key", F.explode("class_keys")).drop(
        "class_keys"
    )


def resolve_personas(requests: DataFrame, principals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with department, clearance and class key, and the rejected rest."""
    known = principals.select(
        F.col("name").alias("persona"),
        "department",
        "clearance",
        class_key("department", "clearance").alias("class_key"),
    )
    joined = requests.join(broadcast_if_small(known), "persona", "left")
    resolved = joined.where(F.col("class_key").isNotNull())
    rejected = joined.where(F.col("class_key").isNull()).select(*requests.columns)
    return resolved, rejected


def require_known(rejected: DataFrame) -> None:
    """Raise when any request names an unknown persona."""
    if not rejected.isEmpty():
        raise UnknownPersona("unknown persona")


def violations(hits: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Ids in ``hits`` their own principal may not see; a null verdict counts."""
    verdict = visible("required_clearance", "allowed_departments", "clearance", "department")
    return hits.where(~verdict).select(
        "request_id", F.lit(kind).alias("resource_kind"), F.col(id_col).alias("resource_id")
    )


def enforce(hits: DataFrame, kind: str = "chunk", id_col: str = "chunk_id") -> DataFrame:
    """Return ``hits`` unchanged, or raise; never filter quietly.

    All violations are stored before the error is raised, and it hands them on.
    """
    found = cut(violations(hits, kind, id_col))
    count = found.count()
    if count:
        raise AccessViolation(kind, found, count)
    return hits


def hydrate(
    ranked: DataFrame, chunks: DataFrame, documents: DataFrame, clauses: DataFrame
) -> DataFrame:
    """Ranked ids to hits, permissions checked again; out-of-scope ids drop out.

    ``ranked`` has request_id, rank, chunk_id, department, clearance.  The
    order asked for is kept in ``rank``.
    """
    titled = documents.select(
        "document_id",
        F.col("title").alias("doc_title"),
        "required_clearance",
        "allowed_departments",
    )
    codes = clauses.select("clause_id", F.col("code").alias("clause_code"))
    texts = chunks.select("chunk_id", "document_id", "clause_id", "text")
    return (
        settle(ranked)
        .join(texts, "chunk_id")
        .join(titled, "document_id")
        .join(codes, "clause_id", "left")
        .where(visible("required_clearance", "allowed_departments", "clearance", "department"))
        .select(
            *ranked.columns,
            "text",
            "doc_title",
            "clause_code",
            "required_clearance",
            F.coalesce(
                F.col("allowed_departments"), F.array().cast("array<string>")
            ).alias("allowed_departments"),
        )
    )


def clause_codes(
    ranked: DataFrame, chunks: DataFrame, documents: DataFrame, clauses: DataFrame
) -> DataFrame:
    """Ranked ids to clause codes only, under the same contract as ``hydrate``."""
    permitted = documents.select("document_id", "required_clearance", "allowed_departments")
    codes = clauses.select("clause_id", "code")
    return (
        settle(ranked)
        .join(chunks.select("chunk_id", "document_id", "clause_id"), "chunk_id")
        .join(permitted, "document_id")
        .join(codes, "clause_id", "left")
        .where(visible("required_clearance", "allowed_departments", "clearance", "department"))
        .select(
            *ranked.columns,
            F.when(F.col("clause_id").isNull(), C.OUTSIDE_CLAUSE)
            .otherwise(F.col("code"))
            .alias("clause_code"),
        )
    )


def visible_documents(documents: DataFrame, principals: DataFrame) -> DataFrame:
    """One row per (principal, document it may see)."""
    seen = visible_classes(documents, principal_classes(principals))
    named = principals.select("name", class_key("department", "clearance").alias("class_key"))
    return seen.join(named, "class_key").drop("class_key")


def visible_document_counts(documents: DataFrame, principals: DataFrame) -> DataFrame:
    """Documents visible to each principal, zero included.

    Counted per class first; principals only join the few class counts.
    """
    sets = class_sets(documents, principal_classes(principals))
    per_signature = (
        documents.withColumn("access_keys", access_keys("allowed_departments"))
        .groupBy("required_clearance", "access_keys")
        .agg(F.count("*").alias("n"))
    )
    per_class = (
        per_signature.join(sets, ["required_clearance", "access_keys"])
        .select("n", F.explode("class_keys").alias("class_key"))
        .groupBy("class_key")
        .agg(F.sum("n").alias("n"))
    )
    return principals.withColumn("class_key", class_key("department", "clearance")).join(
        broadcast_if_small(per_class), "class_key", "left"
    ).select("name", F.coalesce("n", F.lit(0)).alias("document_count"))
