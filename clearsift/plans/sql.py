"""Common table expressions for the SQL checks (DuckDB over the same tables)."""

from clearsift.plans.corpus import DEPARTMENTS, PARTS, TOPICS

_DEPT = "[" + ", ".join(f"'{d}'" for d in DEPARTMENTS) + "]"


def dept(number: str) -> str:
    return f"{_DEPT}[CAST(({number}) AS BIGINT) % {len(DEPARTMENTS)} + 1]"


def depts(number: str) -> str:
    quarter = f"({number} // 4)"
    return (
        f"CASE WHEN {number} % 8 = 0 THEN [{dept(quarter)}, {dept(quarter + ' + 2')}]"
        f" WHEN {number} % 4 = 0 THEN [{dept(quarter)}]"
        f" WHEN {number} % 4 = 1 THEN CAST([] AS VARCHAR[]) END"
    )


def vis(row: str, who: str) -> str:
    return (
        f"({row}.required_clearance <= {who}.clearance AND ({row}.allowed_departments IS NULL"
        f" OR len({row}.allowed_departments) = 0"
        f" OR list_contains({row}.allowed_departments, {who}.department)))"
    )


def customer(key: str) -> str:
    return f"('Customer#' || lpad(CAST({key} AS VARCHAR), 9, '0'))"


MANY = "(SELECT count(*) FROM customer)"
ASKER = f"(user_id + event_id * 151) % {MANY}"
CODE_OF_DOC = "'1.' || (src + 1) || '.' || (document_id % 40)"

CTES = {
    "people": (
        [],
        "SELECT c_name AS name, c_mktsegment AS department,"
        " CAST(c_nationkey % 3 + 1 AS INTEGER) AS clearance,"
        " ['member','auditor','developer'][c_custkey % 3 + 1] AS role FROM customer",
    ),
    "classes": (["people"], "SELECT DISTINCT department, clearance FROM people"),
    "docs": (
        [],
        "SELECT doc_id AS document_id, source || ' ' || lang || ' ' || doc_id AS title,"
        " source || '/' || doc_id || '.' || CASE WHEN lang = 'en' THEN 'md' ELSE 'pdf' END AS source_path,"
        " CASE WHEN lang = 'en' THEN 'md' ELSE 'pdf' END AS doc_type,"
        " CAST(doc_id % 3 + 1 AS INTEGER) AS required_clearance,"
        f" {depts('doc_id')} AS allowed_departments,"
        " CAST(substr(source, 4) AS INTEGER) AS src, text FROM documents",
    ),
    "clauses": (
        ["docs"],
        f"SELECT document_id AS clause_id, document_id, {CODE_OF_DOC} AS code,"
        f" 'Section ' || {CODE_OF_DOC} AS title FROM docs",
    ),
    "chunks": (
        ["docs"],
        f"SELECT document_id * {PARTS} + o AS chunk_id, document_id, o AS ordinal, title AS doc_title,"
        f" CASE WHEN document_id % 5 <> 0 THEN {CODE_OF_DOC} END AS clause_code,"
        " CASE WHEN document_id % 5 <> 0 THEN document_id END AS clause_id,"
        " required_clearance, allowed_departments, substring(text, 1 + o * 750, 900) AS text"
        " FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 900 THEN 1"
        " ELSE CAST(ceil((length(text) - 900) / 750.0) AS BIGINT) + 1 END)) AS o FROM docs"
        " WHERE regexp_matches(text, '\\S'))",
    ),
    "vchunks": (
        ["docs"],
        "SELECT e.vec_id AS chunk_id, d.document_id,"
        " CASE WHEN d.document_id % 5 <> 0 THEN d.document_id END AS clause_id, label,"
        " CAST(embedding AS DOUBLE[]) AS embedding, required_clearance, allowed_departments"
        " FROM embeddings e JOIN docs d ON d.document_id = e.vec_id % (SELECT count(*) FROM documents)",
    ),
    "topics": (
        [],
        "SELECT query_id, list(value ORDER BY pos) AS vector FROM (SELECT CAST(label AS BIGINT) AS query_id,"
        " pos, avg(CAST(embedding[pos] AS DOUBLE)) AS value FROM (SELECT label, embedding,"
        " unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY ALL) GROUP BY query_id",
    ),
    # Vector search of every topic by every class of principals.
    "vdist": (
        ["vchunks", "topics"],
        "SELECT query_id, c.*, round(1 - list_dot_product(embedding, vector)"
        " / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(vector, vector))), 12)"
        " AS distance FROM vchunks c, topics",
    ),
    "vranked": (
        ["vdist", "classes"],
        "SELECT query_id, k.department, k.clearance, chunk_id, document_id, clause_id, label, distance,"
        " row_number() OVER (PARTITION BY query_id, k.department, k.clearance ORDER BY distance, chunk_id) AS rank"
        f" FROM vdist d JOIN classes k ON {vis('d', 'k')}",
    ),
    "vnaive": (
        ["vdist"],
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vdist",
    ),
    "reqs": (
        ["people"],
        f"SELECT event_id AS request_id, {customer(ASKER)} AS persona,"
        f" event_id % {TOPICS} AS query_id, ts, 'topic ' || (event_id % {TOPICS}) AS query,"
        " CASE WHEN user_id % 7 <> 0 THEN 's' || (user_id % 7) END AS session_id, p.department, p.clearance"
        f" FROM events JOIN people p ON p.name = {customer(ASKER)}",
    ),
    "vhits": (
        ["reqs", "vranked"],
        "SELECT r.request_id, r.persona, r.query_id, r.department, r.clearance, v.rank, v.chunk_id,"
        " v.document_id, v.clause_id, v.label, v.distance"
        " FROM reqs r JOIN vranked v USING (query_id, department, clearance) WHERE v.rank <= 10",
    ),
    "nhits": (
        ["reqs", "vnaive"],
        "SELECT r.request_id, r.persona, v.rank AS naive_rank, v.chunk_id, v.document_id, v.clause_id, v.distance"
        f" FROM reqs r JOIN vnaive v ON v.query_id = r.query_id AND v.rank <= 10 AND {vis('v', 'r')}",
    ),
    "sreqs": (
        ["people"],
        f"SELECT conv_id * {PARTS} + turn AS request_id, conv_id AS session_id, turn AS call_no,"
        f" (conv_id + turn) % {TOPICS} AS query_id, p.department, p.clearance FROM conversations"
        f" JOIN people p ON p.name = {customer(f'conv_id % {MANY}')} WHERE conversations.role = 'user'",
    ),
    "words": (
        ["chunks"],
        "SELECT chunk_id, lexeme, count(*) AS tf FROM (SELECT chunk_id,"
        " unnest(regexp_extract_all(lower(concat_ws(' ', clause_code, doc_title, text)),"
        " '[\\p{L}\\p{N}]+(?:\\.[\\p{L}\\p{N}]+)*')) AS lexeme FROM chunks) GROUP BY ALL",
    ),
    "weighted": (
        ["words"],
        "SELECT chunk_id, lexeme, tf, list_sum(list_transform(range(1, tf + 1),"
        " lambda j: 1.0::DOUBLE / (j * j))) AS weight FROM words",
    ),
    "terms": (
        [],
        "SELECT item_id AS query_id, term, count(*) OVER (PARTITION BY item_id) AS n_terms FROM"
        " (SELECT DISTINCT item_id, lower(w) AS term FROM (SELECT item_id,"
        " unnest(regexp_extract_all(text, '[0-9A-Za-z가-힣]+(?:\\.[0-9A-Za-z가-힣]+)*')) AS w FROM benchmark)"
        " WHERE length(w) >= 2)",
    ),
    "matches": (
        ["words", "terms"],
        "SELECT query_id, lexeme, count(*) / any_value(n_terms) AS share FROM"
        " (SELECT DISTINCT lexeme FROM words) v JOIN terms t ON starts_with(v.lexeme, t.term)"
        " GROUP BY query_id, lexeme",
    ),
    "kscores": (
        ["weighted", "matches"],
        "SELECT query_id, chunk_id, round(sum(weight * share), 9) AS score"
        " FROM weighted JOIN matches USING (lexeme) GROUP BY query_id, chunk_id",
    ),
    "treqs": (
        ["people"],
        "SELECT item_id * 10 + j AS request_id, item_id AS query_id, j AS persona_no, text AS query,"
        " p.name AS persona, p.department, p.clearance FROM benchmark, unnest(range(3)) AS t(j)"
        f" JOIN people p ON p.name = {customer(f'(item_id * 7 + j * 11) % {MANY}')}",
    ),
    "tclasses": (["treqs"], "SELECT DISTINCT query_id, department, clearance FROM treqs"),
    "kranked": (
        ["kscores", "tclasses", "chunks"],
        "SELECT s.query_id, t.department, t.clearance, s.chunk_id, s.score,"
        " row_number() OVER (PARTITION BY s.query_id, t.department, t.clearance"
        " ORDER BY s.score DESC, s.chunk_id) AS rank FROM kscores s JOIN chunks c USING (chunk_id)"
        f" JOIN tclasses t ON t.query_id = s.query_id AND {vis('c', 't')}",
    ),
    "hashed": (
        ["chunks"],
        "SELECT 'c' AS kind, chunk_id AS id, unnest(regexp_extract_all(lower('passage: ' || text),"
        " '[\\p{L}\\p{N}]+(?:\\.[\\p{L}\\p{N}]+)*')) AS w FROM chunks UNION ALL"
        " SELECT 'q', item_id, unnest(regexp_extract_all(lower('query: ' || text),"
        " '[\\p{L}\\p{N}]+(?:\\.[\\p{L}\\p{N}]+)*')) FROM benchmark",
    ),
    "places": (
        ["hashed"],
        "SELECT w, h % 64 AS dim, 1 - 2 * ((h // 64) % 2) AS sign FROM (SELECT w,"
        " CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT w FROM hashed))",
    ),
    "cells": (
        ["hashed", "places"],
        "SELECT kind, id, dim, CAST(sum(sign) AS DOUBLE) AS v FROM hashed JOIN places USING (w) GROUP BY ALL",
    ),
    "norms": (["cells"], "SELECT kind, id, sqrt(sum(v * v)) AS norm FROM cells GROUP BY ALL"),
    "encoded": (
        ["cells", "norms"],
        "SELECT kind, id, dim, CAST(CAST(v / CASE WHEN norm = 0 THEN 1 ELSE norm END AS FLOAT) AS DOUBLE) AS v"
        " FROM cells JOIN norms USING (kind, id)",
    ),
    "lengths": (
        ["encoded"],
        "SELECT kind, id, sqrt(sum(v * v)) AS len FROM encoded GROUP BY ALL",
    ),
    "tdist": (
        ["encoded", "lengths"],
        "SELECT q.id AS query_id, c.id AS chunk_id, CASE WHEN any_value(lq.len) * any_value(lc.len) = 0 THEN NULL"
        " ELSE round(1 - sum(q.v * c.v) / (any_value(lq.len) * any_value(lc.len)), 12) END AS distance"
        " FROM encoded q JOIN encoded c ON q.dim = c.dim AND q.kind = 'q' AND c.kind = 'c'"
        " JOIN lengths lq ON lq.kind = 'q' AND lq.id = q.id JOIN lengths lc ON lc.kind = 'c' AND lc.id = c.id"
        " GROUP BY q.id, c.id",
    ),
    "tranked": (
        ["tdist", "tclasses", "chunks"],
        "SELECT s.query_id, t.department, t.clearance, s.chunk_id, s.distance,"
        " row_number() OVER (PARTITION BY s.query_id, t.department, t.clearance"
        " ORDER BY s.distance NULLS LAST, s.chunk_id) AS rank FROM tdist s JOIN chunks c USING (chunk_id)"
        f" JOIN tclasses t ON t.query_id = s.query_id AND {vis('c', 't')}",
    ),
    "fused": (
        ["tranked", "kranked"],
        "SELECT *, row_number() OVER (PARTITION BY query_id, department, clearance"
        " ORDER BY score DESC, list_no, pos) AS rank FROM (SELECT query_id, department, clearance, chunk_id,"
        " sum(1.0::DOUBLE / (60 + pos)) AS score, min(list_no) AS list_no, arg_min(pos, list_no) AS pos FROM"
        " (SELECT query_id, department, clearance, chunk_id, rank - 1 AS pos, 0 AS list_no FROM tranked WHERE rank <= 50"
        " UNION ALL SELECT query_id, department, clearance, chunk_id, rank - 1, 1 FROM kranked WHERE rank <= 50)"
        " GROUP BY query_id, department, clearance, chunk_id)",
    ),
    "hybrid": (
        ["treqs", "fused"],
        "SELECT r.request_id, r.persona, r.persona_no, r.query_id, r.department, r.clearance, f.rank, f.chunk_id, f.score"
        " FROM treqs r JOIN fused f USING (query_id, department, clearance) WHERE f.rank <= 10",
    ),
    "hosts": (
        [],
        f"SELECT 'host-' || n_nationkey AS name, {dept('n_nationkey')} AS department,"
        " CAST(n_nationkey % 3 + 1 AS INTEGER) AS required_clearance,"
        f" {depts('n_nationkey')} AS allowed_departments FROM nation",
    ),
    "logs": (
        [],
        "SELECT event_id, CASE WHEN event_id % 997 <> 0 THEN ts END AS ts, 'host-' ||"
        " CASE WHEN day(ts) % 5 = 0 AND user_id % 27 >= 25 THEN user_id % 27 ELSE user_id % 25 END AS host,"
        " 'app' AS process, event_type, 'u' || user_id AS principal_name, props AS raw FROM events",
    ),
    "lreqs": (
        ["people"],
        f"SELECT event_id AS request_id, {customer(ASKER)} AS persona, p.department, p.clearance,"
        " CASE WHEN event_id % 101 = 0 THEN '*' WHEN event_id % 6 <> 5 THEN ['signup','error','click','view','purchase'][event_id % 6 + 1] END AS event_type,"
        " CASE WHEN event_id % 4 <> 3 THEN date_trunc('second', ts) END AS since,"
        " greatest(1, least(event_id % 60, 50)) AS lim"
        f" FROM events JOIN people p ON p.name = {customer(ASKER)}",
    ),
    "lranked": (
        ["logs", "hosts", "classes"],
        "SELECT k.department, k.clearance, kind, e.*, row_number() OVER (PARTITION BY k.department, k.clearance, kind"
        " ORDER BY ts DESC NULLS LAST, event_id DESC) AS rank FROM (SELECT *, unnest([{'any': false, 'type': event_type}, {'any': true, 'type': ''}]) AS kind FROM logs) e"
        f" JOIN hosts h ON h.name = e.host JOIN classes k ON {vis('h', 'k')} QUALIFY rank <= 50",
    ),
    "lhits": (
        ["lreqs", "lranked"],
        "SELECT r.request_id, r.department, r.clearance, e.rank, e.event_id, e.ts, e.host, e.event_type, e.raw"
        " FROM lreqs r JOIN lranked e ON e.department = r.department AND e.clearance = r.clearance"
        " AND e.kind = {'any': r.event_type IS NULL, 'type': coalesce(r.event_type, '')} AND e.rank <= r.lim AND (r.since IS NULL OR e.ts >= r.since)",
    ),
    "lines": (
        [],
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS file, CASE WHEN event_id % 31 = 0"
        " THEN 'Feb 30' || substring(line, 7, 200) ELSE line END AS value FROM (SELECT *, strftime(ts, '%b ')"
        " || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S ') || 'host-' ||"
        " CASE WHEN day(ts) % 5 = 0 AND user_id % 27 >= 25 THEN user_id % 27 ELSE user_id % 25 END"
        " || ' sshd[' || event_id || ']: ' || ["
        "'Failed password for invalid user u' || user_id || ' from 10.0.0.1 port 22',"
        "'Failed password for u' || user_id || ' from 10.0.0.1 port 22 ssh2',"
        "'pam_unix: authentication failure; rhost=x user=u' || user_id,"
        "'Accepted publickey for u' || user_id || ' from 10.0.0.2',"
        "'pam_unix(sshd:session): session opened for user u' || user_id,"
        "'pam_unix(sshd:session): session closed for user u' || user_id,"
        "' u' || user_id || ' : TTY=pts/1 ; PWD=/srv ; USER=root',"
        "'Permission denied on /srv for user u' || user_id,"
        "'(root) CMD (backup ' || props || ')'][event_id % 9 + 1] AS line FROM events)",
    ),
    "parsed": (
        ["lines"],
        "SELECT event_id, file, value AS raw, CASE WHEN event_id % 31 <> 0 THEN"
        " strptime('2024 ' || substring(value, 1, 15), '%Y %b %d %H:%M:%S') END AS ts,"
        " regexp_extract(value, '^\\S+\\s+\\S+\\s+\\S+\\s+(\\S+)', 1) AS host, 'sshd' AS process,"
        " ['auth_failure','auth_failure','auth_failure','session_open','session_open','session_close',"
        "'privilege_use','access_denied','other'][event_id % 9 + 1] AS event_type,"
        " CASE WHEN event_id % 9 <> 8 THEN regexp_extract(regexp_extract(value, 'sshd.*'), '[ =](u[0-9]+)', 1) END AS principal_name"
        " FROM lines",
    ),
    "refused": (
        ["parsed", "hosts"],
        "SELECT DISTINCT file FROM parsed WHERE ts IS NOT NULL AND host NOT IN (SELECT name FROM hosts)",
    ),
    "access": (
        ["people"],
        f"SELECT event_id AS record_id, ts, {customer(ASKER)} AS persona, p.department, p.clearance,"
        f" 'topic ' || (event_id % {TOPICS}) AS query, CASE WHEN event_id % 3 <> 0 THEN"
        " '1.' || (user_id % 20 + 1) || '.' || (event_id % 40) END AS clause_code,"
        " CASE WHEN event_id % 2 = 0 THEN 'chunk' ELSE 'log_event' END AS resource_kind,"
        " event_id % 700 AS resource_id, event_type <> 'error' AS allowed,"
        " CASE WHEN user_id % 7 <> 0 THEN 's' || (user_id % 7) END AS session_id"
        f" FROM events JOIN people p ON p.name = {customer(ASKER)}",
    ),
    "answers": (
        [],
        f"SELECT conv_id * {PARTS} + turn AS answer_id, text || ' See 1.' || (conv_id % 20 + 1) || '.' ||"
        " ((conv_id * 3 + turn) % 40) || ' and [1.' || ((conv_id * 3 + 1) % 20 + 1) || '.' || ((conv_id * 3 + 1) % 40)"
        " || '], [1.' || (turn % 20 + 1) || '.' || (conv_id % 40) || '] of 2026.09.04.' AS answer"
        " FROM conversations WHERE role = 'assistant'",
    ),
    "ahits": (
        ["docs"],
        "SELECT answer_id, document_id AS chunk_id, CASE WHEN document_id % 5 <> 0 THEN"
        f" {CODE_OF_DOC} END AS clause_code FROM (SELECT conv_id * {PARTS} + turn AS answer_id,"
        " unnest(range(conv_id * 3, conv_id * 3 + 5)) AS document_id FROM conversations WHERE role = 'assistant')"
        " JOIN docs USING (document_id)",
    ),
    "cited": (
        ["answers", "ahits"],
        "SELECT answer_id, code, min(pos) AS position, CASE WHEN bool_or(hit) THEN 'cited' ELSE 'fabricated' END AS status"
        " FROM (SELECT a.answer_id, a.pos, a.token, replace(replace(a.token, '[', ''), ']', '') AS code,"
        " EXISTS (SELECT 1 FROM ahits h WHERE h.answer_id = a.answer_id AND"
        " h.clause_code = replace(replace(a.token, '[', ''), ']', '')) AS hit"
        " FROM (SELECT answer_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT answer_id,"
        " regexp_extract_all(answer, '\\[\\d+\\.\\d+\\.\\d+\\]|\\d+\\.\\d+\\.\\d+') AS t FROM answers)) a)"
        " WHERE hit OR token LIKE '[%' GROUP BY answer_id, code",
    ),
}


def with_(*names: str, extra: dict | None = None) -> str:
    """A WITH clause holding the named expressions and all they rest on."""
    known = dict(CTES)
    for name, (needs, body) in (extra or {}).items():
        known[name] = (needs, body)
    order = []

    def need(name):
        for other in known[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({known[n][1]})" for n in order) + " "
