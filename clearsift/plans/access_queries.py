"""Registered queries: access records, catalogue, citations, quality."""

from pyspark.sql import functions as F

from clearsift.constants import MASKED_QUERY
from clearsift.functions.access import masked_query
from clearsift.functions.scale import cut, scratch_path
from clearsift.operators import access_log, audits, citations, entitlements, evaluation
from clearsift.operators.vector_search import vector_topk
from clearsift.plans import corpus
from clearsift.plans.registry import ints, query
from clearsift.plans.search_queries import _hybrid, _unfiltered_hits, _vector_hits
from clearsift.plans.sql import customer, vis, with_
from clearsift.sources import tables

K = 10
SESSION = "s3"
MASKED = MASKED_QUERY
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# ---------------------------------------------------------- access records


@query(
    "masked_queries",
    with_("access")
    + f"SELECT record_id, CASE WHEN session_id = 's' || (record_id % 8) THEN query ELSE '{MASKED}' END AS shown FROM access",
)
def masked_queries(spark, folder):
    """Each record as shown to a viewer: only the own session's text is readable."""
    viewer = F.when(F.col("record_id") % 8 != 0, F.concat(F.lit("s"), F.col("record_id") % 8)).otherwise("")
    return corpus.access_records(spark, folder).select(
        "record_id", masked_query("query", F.col("session_id"), viewer).alias("shown")
    )


def _recent_sql(where: str, limit: int) -> str:
    return (
        with_("access")
        + "SELECT record_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, persona, clause_code, resource_kind, resource_id, allowed,"
        f" CASE WHEN session_id = '{SESSION}' THEN query ELSE '{MASKED}' END AS query FROM access {where}"
        f" ORDER BY access.ts DESC, record_id DESC LIMIT {limit}"
    )


_SHOWN = [
    "record_id",
    "ts",
    "persona",
    "clause_code",
    "resource_kind",
    "resource_id",
    "allowed",
    "query",
]


def _shown(rows):
    return rows.select(*_SHOWN).withColumn("ts", F.date_format("ts", STAMP))


@query("recent_access", _recent_sql("", 50))
def recent_access(spark, folder):
    """The newest records, other sessions' questions masked."""
    return _shown(access_log.recent(corpus.access_records(spark, folder), 50, SESSION))


@query("recent_violations", _recent_sql("WHERE NOT allowed", 20))
def recent_violations(spark, folder):
    """The newest blocked records."""
    return _shown(access_log.blocked(corpus.access_records(spark, folder), 20, SESSION))


@query(
    "dashboard",
    with_("access")
    + "SELECT count(DISTINCT (query, persona, ts)) AS queries, count(DISTINCT CASE WHEN resource_kind = 'chunk' THEN resource_id END)"
    " AS chunks_read, count(*) FILTER (NOT allowed) AS blocked FROM access",
)
def dashboard(spark, folder):
    """Questions, documents read and blocked requests over the whole history."""
    return access_log.dashboard(corpus.access_records(spark, folder))


_NEWEST = "FROM access {} ORDER BY ts DESC, record_id DESC LIMIT 200"


@query(
    "dashboard_latest",
    with_("access")
    + "SELECT (SELECT count(DISTINCT (query, persona, ts)) FROM (SELECT * "
    + _NEWEST.format("")
    + ")) AS queries, (SELECT count(DISTINCT resource_id) FILTER (resource_kind = 'chunk') FROM (SELECT * "
    + _NEWEST.format("")
    + ")) AS chunks_read, (SELECT count(*) >= 200 FROM access) AS truncated, (SELECT count(*) FROM (SELECT * "
    + _NEWEST.format("WHERE NOT allowed")
    + ")) AS blocked, (SELECT count(*) >= 200 FROM access WHERE NOT allowed) AS blocked_truncated",
)
def dashboard_latest(spark, folder):
    """The tiles over the newest 200 records, flagged when there may be more."""
    return access_log.dashboard_latest(corpus.access_records(spark, folder))


@query(
    "access_personas",
    with_("access")
    + "SELECT persona, count(*) AS records, count(*) FILTER (NOT allowed) AS blocked FROM access GROUP BY persona",
)
def access_personas(spark, folder):
    """Personas found in the records."""
    return access_log.personas(corpus.access_records(spark, folder))


@query(
    "access_filters",
    with_("access")
    + "SELECT 'blocked' AS filter, record_id FROM access WHERE NOT allowed UNION ALL SELECT 'persona', record_id FROM access"
    f" WHERE persona = {customer('7')}",
)
def access_filters(spark, folder):
    """The record table under its two filters."""
    records = corpus.access_records(spark, folder)
    blocked = access_log.filtered(records, blocked_only=True)
    mine = access_log.filtered(records, persona="Customer#000000007")
    return blocked.select(F.lit("blocked").alias("filter"), "record_id").unionByName(
        mine.select(F.lit("persona").alias("filter"), "record_id")
    )


@query(
    "hit_records",
    with_("vhits", "reqs", "clauses")
    + "SELECT v.persona, v.department, v.clearance, r.query, c.code AS clause_code, 'chunk' AS resource_kind,"
    " v.chunk_id AS resource_id, true AS allowed, r.session_id, strftime(r.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"
    " FROM vhits v JOIN reqs r USING (request_id) LEFT JOIN clauses c ON c.clause_id = v.clause_id",
)
def hit_records(spark, folder):
    """One allowed record per chunk handed out."""
    requests, hits = _vector_hits(spark, folder)
    records = access_log.hit_records(_with_codes(spark, folder, hits), requests)
    exposed = audits.exposed_columns(records)
    if exposed:
        raise ValueError(f"access records would carry {exposed}")
    return records.withColumn("ts", F.date_format("ts", STAMP))


def _with_codes(spark, folder, hits):
    coded = corpus.vector_chunks(spark, folder).select("chunk_id", "clause_id").join(
        corpus.clauses(spark, folder).select("clause_id", F.col("code").alias("clause_code")),
        "clause_id",
        "left",
    )
    return hits.join(coded, "chunk_id")


@query(
    "violation_records",
    with_("reqs", "vnaive")
    + "SELECT r.persona, r.query, CAST(NULL AS VARCHAR) AS clause_code, 'chunk' AS resource_kind, v.chunk_id AS resource_id,"
    f" false AS allowed, r.session_id FROM reqs r JOIN vnaive v ON v.query_id = r.query_id AND v.rank <= {K} WHERE NOT {vis('v', 'r')}",
)
def violation_records(spark, folder):
    """One blocked record per id that a broken retriever let through."""
    try:
        found = entitlements.violations(entitlements.enforce(_unfiltered_hits(spark, folder)))
    except entitlements.AccessViolation as refused:
        found = refused.rows  # all of them, to be recorded before anything is answered
    records = access_log.violation_records(found, corpus.topic_requests(spark, folder))
    return records.drop("ts", "department", "clearance")


@query(
    "append_access_records",
    with_("access")
    + "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, count(DISTINCT resource_id) AS resources FROM access GROUP BY ALL",
)
def append_access_records(spark, folder):
    """Records appended to day partitions; appending nothing writes nothing."""
    path = scratch_path(spark, "records")
    records = corpus.access_records(spark, folder)
    tables.append_records(records, path)
    tables.append_records(records.where("false"), path)
    return spark.read.parquet(path).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(
        F.count("*").alias("n"), F.count_distinct("resource_id").alias("resources")
    )


# --------------------------------------------------------------- catalogue


_LISTED = (
    "SELECT d.document_id, d.title, d.doc_type, d.required_clearance, array_to_string(coalesce(d.allowed_departments, []), ',')"
    " AS departments, d.source_path, count(v.chunk_id) AS chunk_count FROM docs d LEFT JOIN vchunks v USING (document_id)"
    " GROUP BY ALL"
)


def _catalogue(spark, folder):
    return access_log.catalogue(
        corpus.documents(spark, folder), corpus.vector_chunks(spark, folder).select("document_id")
    )


@query("catalogue", with_("docs", "vchunks") + _LISTED)
def catalogue(spark, folder):
    """Documents with chunk counts, zero included, and no body."""
    listing = _catalogue(spark, folder)
    return listing.withColumn("departments", F.array_join("allowed_departments", ",")).drop(
        "allowed_departments"
    )


@query(
    "catalogue_totals",
    with_("docs", "vchunks")
    + f"SELECT count(*) AS documents, CAST(sum(chunk_count) AS BIGINT) AS chunks, count(*) FILTER (doc_type = 'md') AS md_documents FROM ({_LISTED})",
)
def catalogue_totals(spark, folder):
    """Documents, chunks, and documents of one type."""
    return access_log.catalogue_totals(_catalogue(spark, folder), "md")


@query("principals_by_rank", with_("people") + "SELECT name, department, clearance, role FROM people")
def principals_by_rank(spark, folder):
    """Principals by clearance and name."""
    return access_log.principals_by_rank(corpus.principals(spark, folder))


@query(
    "exposed_columns",
    "SELECT 'access_records' AS output, count(*) AS rows, 0::BIGINT AS exposed FROM events UNION ALL"
    " SELECT 'catalogue', count(*), 0 FROM documents",
)
def exposed_columns(spark, folder):
    """Columns of records and catalogue that would carry content out."""
    records = corpus.access_records(spark, folder).select(*access_log.RECORD_COLUMNS)
    listing = _catalogue(spark, folder)
    banned = ("text", "body", "raw")
    parts = [
        rows.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("output"),
            "rows",
            F.lit(len(audits.exposed_columns(rows, names))).cast("long").alias("exposed"),
        )
        for name, rows, names in (
            ("access_records", records, (*banned, "title", "doc_title")),
            ("catalogue", listing, banned),
        )
    ]
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------- citations


@query(
    "citations",
    with_("cited") + "SELECT answer_id, code, CAST(position AS INTEGER) AS position, status FROM cited",
)
def citations_query(spark, folder):
    """Codes each answer cites, and codes it made up."""
    return citations.citations(
        corpus.answers(spark, folder), corpus.answer_hits(spark, folder)
    )


@query(
    "split_evidence",
    with_("cited", "ahits")
    + "SELECT answer_id, chunk_id, clause_code, EXISTS (SELECT 1 FROM cited c WHERE c.answer_id = h.answer_id"
    " AND c.code = h.clause_code AND c.status = 'cited') AS is_cited FROM ahits h",
)
def split_evidence(spark, folder):
    """Hits an answer rests on against hits that are only related."""
    hits = corpus.answer_hits(spark, folder)
    found = citations.citations(corpus.answers(spark, folder), hits)
    used, related = citations.split_evidence(hits, found)
    return used.withColumn("is_cited", F.lit(True)).unionByName(
        related.withColumn("is_cited", F.lit(False))
    )


# ----------------------------------------------------------------- quality


def _golden(spark, folder):
    """Every (topic, class) as a golden query; the topic's chunks are relevant."""
    requests = corpus.topic_requests(spark, folder)
    golden = (
        requests.groupBy("query_id", "class_key")
        .agg(
            F.any_value("department").alias("department"),
            F.any_value("clearance").alias("clearance"),
            F.min("request_id").alias("request_id"),
        )
    )
    return cut(golden)


_GOLDEN = {
    "golden": (
        ["reqs"],
        "SELECT query_id, department, clearance, min(request_id) AS request_id FROM reqs GROUP BY ALL",
    ),
    "coded": (
        ["vchunks", "docs"],
        "SELECT v.chunk_id, v.label, CASE WHEN v.clause_id IS NOT NULL THEN '1.' || (d.src + 1) || '.' || (d.document_id % 40) END AS code"
        " FROM vchunks v JOIN docs d USING (document_id)",
    ),
    "ghits": (
        ["golden", "vranked", "coded"],
        "SELECT g.request_id, v.rank, c.code FROM golden g JOIN vranked v USING (query_id, department, clearance)"
        " JOIN coded c USING (chunk_id) WHERE v.rank <= 10",
    ),
    "relevant": (
        ["golden", "coded"],
        "SELECT DISTINCT g.request_id, c.code FROM golden g JOIN coded c ON c.label = g.query_id WHERE c.code IS NOT NULL",
    ),
    "uniq": (
        ["ghits"],
        "SELECT request_id, code, row_number() OVER (PARTITION BY request_id ORDER BY min(rank)) AS place FROM ghits"
        " WHERE code IS NOT NULL GROUP BY request_id, code",
    ),
    "metrics": (
        ["golden", "uniq", "relevant"],
        "SELECT g.request_id, g.query_id, coalesce(h.n / r.n, 0) AS recall, coalesce(1.0::DOUBLE / h.first, 0) AS mrr,"
        " coalesce(h.dcg / list_sum(list_transform(range(1, least(r.n, 10) + 1), lambda p: 1.0::DOUBLE / log2(p + 1.0::DOUBLE))), 0) AS ndcg"
        " FROM golden g LEFT JOIN (SELECT request_id, count(*) AS n FROM relevant GROUP BY ALL) r USING (request_id)"
        " LEFT JOIN (SELECT u.request_id, count(*) AS n, min(place) AS first, sum(1.0::DOUBLE / log2(place + 1.0::DOUBLE)) AS dcg"
        " FROM uniq u JOIN relevant USING (request_id, code) GROUP BY ALL) h USING (request_id)",
    ),
}


def _retrieved(spark, folder, golden):
    chunks = corpus.vector_chunks(spark, folder)
    hits = vector_topk(
        chunks, golden, corpus.topics(spark, folder), K, corpus.documents(spark, folder)
    )
    return _with_codes(spark, folder, hits).select(
        "request_id", "rank", F.col("clause_code").alias("code")
    )


def _relevant(spark, folder, golden):
    labelled = _with_codes(
        spark, folder, corpus.vector_chunks(spark, folder).select("chunk_id", F.col("label").cast("long").alias("query_id"))
    )
    return golden.select("request_id", "query_id").join(
        labelled.where(F.col("clause_code").isNotNull())
        .select("query_id", F.col("clause_code").alias("code"))
        .distinct(),
        "query_id",
    )


def _metrics(spark, folder):
    golden = _golden(spark, folder)
    return evaluation.query_metrics(
        golden.select("request_id", "query_id"),
        _retrieved(spark, folder, golden),
        _relevant(spark, folder, golden),
        K,
    )


@ints("place")
@query(
    "unique_top_codes",
    with_("uniq", extra=_GOLDEN) + "SELECT request_id, code, place FROM uniq",
)
def unique_top_codes(spark, folder):
    """Distinct codes in first-seen order."""
    return evaluation.unique_top(_retrieved(spark, folder, _golden(spark, folder)), K)


@query(
    "evaluate_golden",
    with_("metrics", extra=_GOLDEN)
    + "SELECT request_id, query_id, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM metrics",
)
def evaluate_golden(spark, folder):
    """Recall, MRR and nDCG of each golden query under its own principal."""
    rounded = [F.round(m, 9).alias(m) for m in ("recall", "mrr", "ndcg")]
    return _metrics(spark, folder).select("request_id", "query_id", *rounded)


@query(
    "quality_summary",
    with_("metrics", extra=_GOLDEN)
    + "SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,"
    " round(median(latency_ms), 6) AS p50_ms, round(list_sort(list(latency_ms))[least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT) + 1)], 6) AS p95_ms"
    " FROM (SELECT m.*, e.value AS latency_ms FROM metrics m JOIN events e ON e.event_id = m.request_id)",
)
def quality_summary(spark, folder):
    """Means over all golden queries and latency percentiles."""
    measured = corpus.table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), F.col("value").alias("latency_ms")
    )
    rows = cut(_metrics(spark, folder)).join(measured, "request_id")
    totals = evaluation.summary(rows)
    return totals.select(
        "n_queries", *[F.round(c, 6).alias(c) for c in totals.columns if c != "n_queries"]
    )


@query(
    "quality_report",
    with_("metrics", extra=_GOLDEN)
    + "SELECT request_id, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM metrics",
)
def quality_report(spark, folder):
    """Per-query scores, the worst recall first; an empty corpus is refused."""
    rows = evaluation.report(_metrics(spark, folder), corpus.vector_chunks(spark, folder))
    return rows.select("request_id", *[F.round(m, 9).alias(m) for m in ("recall", "mrr", "ndcg")])


@query(
    "evaluate_hybrid",
    with_(
        "hybrid",
        "rel",
        "measured",
        extra={
            "rel": (
                ["treqs", "chunks"],
                "SELECT DISTINCT r.request_id, c.clause_code AS code FROM treqs r JOIN chunks c ON c.document_id = r.query_id"
                " WHERE c.clause_code IS NOT NULL",
            ),
            "seen": (
                ["hybrid", "chunks"],
                "SELECT request_id, clause_code AS code, row_number() OVER (PARTITION BY request_id ORDER BY min(rank)) AS place"
                " FROM hybrid JOIN chunks USING (chunk_id) WHERE clause_code IS NOT NULL GROUP BY request_id, clause_code",
            ),
            "measured": (
                ["treqs", "rel", "seen"],
                "SELECT t.request_id, CASE WHEN s.place IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS recall,"
                " coalesce(1.0::DOUBLE / s.place, 0) AS mrr, coalesce(1.0::DOUBLE / log2(s.place + 1.0::DOUBLE), 0) AS ndcg FROM treqs t"
                " LEFT JOIN rel USING (request_id) LEFT JOIN seen s ON s.request_id = rel.request_id AND s.code = rel.code",
            ),
        },
    )
    + "SELECT request_id, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM measured",
)
def evaluate_hybrid(spark, folder):
    """Hybrid search scored per question against the document of the same number."""
    chunks = corpus.stored_chunks(spark, folder)
    requests, hits = _hybrid(spark, folder, chunks=chunks)
    codes = chunks.select(
        "chunk_id", "document_id", F.col("clause_code").alias("code")
    )
    golden = requests.select("request_id", "query_id")
    relevant = golden.join(
        codes.where(F.col("code").isNotNull()).select(F.col("document_id").alias("query_id"), "code"),
        "query_id",
    )
    retrieved = cut(hits.select("request_id", "rank", "chunk_id")).join(codes, "chunk_id")
    rows = evaluation.query_metrics(golden, retrieved, relevant, K)
    return rows.select("request_id", *[F.round(m, 9).alias(m) for m in ("recall", "mrr", "ndcg")])
