"""Hybrid entitled search and what is done with its hits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.access import clamp
from clearsift.functions.scale import cut, hinted
from clearsift.functions.text import neutralize, wrapped
from clearsift.operators.entitlements import enforce, hydrate
from clearsift.operators.fusion import rrf
from clearsift.operators.keyword_search import asked_terms, search_keyword
from clearsift.operators.searches import searches_of
from clearsift.operators.vector_search import search_topk
from clearsift.sources.inverted import InvertedTable


def hybrid_search(
    chunks: DataFrame,
    posting: DataFrame | InvertedTable | None,
    requests: DataFrame,
    queries: DataFrame,
    k: int = C.DEFAULT_K,
    permissions: DataFrame | None = None,
) -> DataFrame:
    """Vector and keyword candidates, each under the same entitlements, fused.

    Every retriever hands over ``5 k`` candidates per distinct (query, class);
    requests only join the fused lists.  ``queries`` has query_id, query and
    vector.  ``k`` is held within 1..20.  Without ``posting`` the words of the
    chunks' texts are searched (see ``search_keyword``).
    """
    k = max(1, min(k, C.MAX_K))
    candidates = k * C.CANDIDATE_MULTIPLIER
    permissions = chunks if permissions is None else permissions
    searches = searches_of(requests, queries, candidates, permissions, asked_terms(), "vector")
    nearest, _ = search_topk(chunks, requests, queries, candidates, searches=searches)
    worded, _ = search_keyword(posting, chunks, requests, queries, candidates, searches=searches)
    columns = ["query_id", "class_key", "chunk_id", (F.col("rank") - 1).alias("pos")]
    lists = nearest.select(*columns, F.lit(0).alias("list_no")).unionByName(
        worded.select(*columns, F.lit(1).alias("list_no"))
    )
    fused = rrf(lists, ["query_id", "class_key"], "chunk_id", dense=True).where(
        F.col("rank") <= k
    )
    return requests.select("request_id", "query_id", "class_key").join(
        hinted(fused, searches.bound(k)), ["query_id", "class_key"]
    ).select("request_id", "rank", "chunk_id", "score")


def asked_k(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Keep what each request asked for: its own ``k`` held within 1..20."""
    wanted = requests.select("request_id", clamp("k", 1, C.MAX_K).alias("k"))
    return hits.join(wanted, "request_id").where(F.col("rank") <= F.col("k")).drop("k")


def policy_search(
    chunks: DataFrame,
    posting: DataFrame | InvertedTable | None,
    documents: DataFrame,
    clauses: DataFrame,
    requests: DataFrame,
    queries: DataFrame,
    k: int = C.DEFAULT_K,
) -> DataFrame:
    """Hybrid search, hydrated under a second permission check, then rechecked.

    The hits are written once so the recheck and the caller read the same rows.
    """
    ranked = hybrid_search(chunks, posting, requests, queries, k, documents)
    scoped = ranked.join(
        requests.select("request_id", "department", "clearance"), "request_id"
    )
    return enforce(cut(hydrate(scoped, chunks, documents, clauses)))


def session_evidence(hits: DataFrame) -> DataFrame:
    """First occurrence of each chunk over a session's searches.

    ``hits`` has session_id, call_no, rank, chunk_id.  The evidence of a session
    is ordered by (call_no, rank); it is not numbered, which would gather a busy
    session in one task.
    """
    first = hits.groupBy("session_id", "chunk_id").agg(
        F.min(F.struct("call_no", "rank")).alias("first")
    )
    return first.select(
        "session_id",
        "chunk_id",
        F.col("first.call_no").alias("call_no"),
        F.col("first.rank").alias("rank"),
    )


def fold_by_clause(hits: DataFrame) -> DataFrame:
    """One row per clause with its first hit and chunk count.

    Hits outside any clause stay apart.
    """
    unit = F.coalesce(F.col("clause_code"), F.concat(F.lit("#"), F.col("chunk_id")))
    return (
        hits.groupBy("request_id", "clause_code", unit.alias("unit"))
        .agg(
            F.min_by("chunk_id", "rank").alias("chunk_id"),
            F.min("rank").alias("rank"),
            F.count("*").alias("chunk_count"),
        )
        .drop("unit")
    )


def compare_paths(entitled: DataFrame, naive: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows and clause codes per request on both paths, and the rows lost.

    Both inputs have request_id, rank, clause_code with at most 20 rows per
    request.
    """

    def folded(hits, prefix):
        ordered = F.sort_array(F.collect_list(F.struct("rank", "clause_code")))
        return hits.groupBy("request_id").agg(
            F.count("*").alias(f"{prefix}_count"),
            F.array_join(F.transform(ordered, lambda h: h["clause_code"]), ",").alias(
                f"{prefix}_codes"
            ),
        )

    joined = (
        requests.select("request_id")
        .join(folded(entitled, "entitled"), "request_id", "left")
        .join(folded(naive, "naive"), "request_id", "left")
    )
    return joined.select(
        "request_id",
        *[F.coalesce(f"{p}_count", F.lit(0)).alias(f"{p}_count") for p in ("entitled", "naive")],
        *[F.coalesce(f"{p}_codes", F.lit("")).alias(f"{p}_codes") for p in ("entitled", "naive")],
        (
            F.coalesce("entitled_count", F.lit(0)) - F.coalesce("naive_count", F.lit(0))
        ).alias("lost"),
    )


def for_personas(queries: DataFrame, personas: DataFrame) -> DataFrame:
    """Each query asked by each selected persona, in the order asked for.

    ``personas`` has query_id and an array of names; unknown names surface in
    ``resolve_personas``.
    """
    asked = personas.select("query_id", F.posexplode("names").alias("persona_no", "persona"))
    return queries.join(asked, "query_id")


def evidence_blocks(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """One labelled text block of evidence per request; fixed text when empty.

    A request has at most 20 hits, so a block is bounded.
    """
    shown = F.when(F.col("clause_code").isNull(), f"[{C.OUTSIDE_CLAUSE}]").otherwise(
        F.concat(F.lit("["), F.col("clause_code"), F.lit("]"))
    )
    entry = F.concat(
        neutralize(shown, C.EVIDENCE_CODE_MAX),
        F.lit(" "),
        neutralize("doc_title", C.EVIDENCE_TITLE_MAX),
        F.lit("\n"),
        neutralize("text", C.EVIDENCE_TEXT_MAX, keep_newlines=True),
    )
    return _blocks(hits, requests, entry, "\n\n", C.EVIDENCE_LABEL, C.NO_EVIDENCE)


def record_blocks(events: DataFrame, requests: DataFrame) -> DataFrame:
    """One labelled text block of log events per request (at most 50 events)."""
    return _blocks(events, requests, record_entry(), "\n", C.RECORD_LABEL, C.NO_RECORDS)


def listed_blocks(lists: DataFrame) -> DataFrame:
    """As ``record_blocks`` for requests that have their events as a list, with
    the ``entry`` of each; nothing is shuffled."""
    body = F.array_join(F.transform("events", lambda e: e["entry"]), "\n")
    block = F.when(F.size("events") > 0, wrapped(C.RECORD_LABEL, body))
    return lists.select("request_id", F.coalesce(block, F.lit(C.NO_RECORDS)).alias("block"))


def record_entry() -> Column:
    """A log event as a line of a block."""
    time = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(C.UNKNOWN_TIME))
    return F.concat(
        time,
        F.lit(" ["),
        neutralize("host", C.RECORD_HOST_MAX),
        F.lit("] "),
        neutralize("event_type", C.RECORD_TYPE_MAX),
        F.lit(" "),
        neutralize("raw"),
    )


def _blocks(rows, requests, entry, separator, label, nothing) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("rank", "entry")))
    body = F.array_join(F.transform(parts, lambda p: p["entry"]), separator)
    blocks = (
        rows.select("request_id", "rank", entry.alias("entry"))
        .groupBy("request_id")
        .agg(wrapped(label, body).alias("block"))
    )
    return requests.select("request_id").join(blocks, "request_id", "left").select(
        "request_id", F.coalesce("block", F.lit(nothing)).alias("block")
    )
