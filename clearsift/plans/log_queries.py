"""Registered queries: log loading, entitled log questions, streams."""

from pyspark.sql import functions as F

from clearsift.constants import EVENT_TYPES, LOG_SCOPE_NOTICE
from clearsift.functions.scale import cut, scratch_path
from clearsift.operators import audits, entitlements, logs, retrieval, syslog
from clearsift.plans import corpus
from clearsift.plans.registry import ints, query
from clearsift.plans.sql import vis, with_
from clearsift.sources import files, readers
from clearsift.streaming import access as access_stream
from clearsift.streaming import logs as log_stream

STAMP = "yyyy-MM-dd HH:mm:ss"


def _stamp(column):
    return F.date_format(column, STAMP).alias("ts")


def _parsed(spark, folder):
    return syslog.parse_syslog(corpus.syslog_lines(spark, folder), corpus.YEAR)


@query(
    "parse_syslog",
    with_("parsed")
    + "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN ts IS NOT NULL THEN host END AS host,"
    " CASE WHEN ts IS NOT NULL THEN process END AS process, CASE WHEN ts IS NOT NULL THEN event_type END AS event_type,"
    " CASE WHEN ts IS NOT NULL THEN principal_name END AS principal_name, raw FROM parsed",
)
def parse_syslog(spark, folder):
    """Lines to typed events; impossible dates yield no event."""
    good, skipped = syslog.split_parsed(_parsed(spark, folder))
    columns = ["event_id", _stamp("ts"), "host", "process", "event_type", "principal_name", "raw"]
    return good.select(*columns).unionByName(
        skipped.select("event_id", "raw"), allowMissingColumns=True
    )


@query(
    "classify_events",
    with_("parsed")
    + "SELECT event_type, count(*) AS n, count(DISTINCT principal_name) AS users FROM parsed WHERE ts IS NOT NULL GROUP BY event_type",
)
def classify_events(spark, folder):
    """Events per type read off the message, first pattern first."""
    return (
        _parsed(spark, folder)
        .where(F.col("ts").isNotNull())
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), F.count_distinct("principal_name").alias("users"))
    )


def _stored_before(parsed):
    """Lines of the first half of the month had been loaded already."""
    return parsed.where(F.dayofmonth("ts") < 15)


@query(
    "load_logs",
    with_("parsed", "refused")
    + "SELECT file, count(*) AS n, count(DISTINCT host) AS hosts FROM parsed WHERE ts IS NOT NULL AND day(ts) >= 15"
    " AND file NOT IN (SELECT file FROM refused) GROUP BY file",
)
def load_logs(spark, folder):
    """Rows to insert: each line delivered twice, half of them stored before."""
    parsed = cut(_parsed(spark, folder))
    twice = parsed.unionByName(parsed)
    accepted = logs.accepted_events(twice, corpus.hosts(spark, folder), _stored_before(parsed))
    return accepted.groupBy("file").agg(
        F.count("*").alias("n"), F.count_distinct("host").alias("hosts")
    )


@query(
    "load_report",
    with_("parsed", "refused")
    + "SELECT file, count(ts) AS parsed, count(*) - count(ts) AS skipped, CASE WHEN file IN (SELECT file FROM refused)"
    " THEN 0 ELSE count(ts) FILTER (day(ts) >= 15) END AS inserted, file IN (SELECT file FROM refused) AS refused"
    " FROM parsed GROUP BY file",
)
def load_report(spark, folder):
    """Parsed, skipped and inserted lines per file; refused files insert nothing."""
    parsed, hosts = cut(_parsed(spark, folder)), corpus.hosts(spark, folder)
    accepted = logs.accepted_events(parsed, hosts, _stored_before(parsed))
    return logs.load_report(parsed, accepted, hosts)


@query(
    "unregistered_hosts",
    with_("parsed", "hosts")
    + "SELECT DISTINCT file, host FROM parsed WHERE ts IS NOT NULL AND host NOT IN (SELECT name FROM hosts)",
)
def unregistered_hosts(spark, folder):
    """Hosts named in files but absent from the registry."""
    events = _parsed(spark, folder).where(F.col("ts").isNotNull())
    return logs.unregistered_hosts(events, corpus.hosts(spark, folder), "file").select(
        "file", "host"
    )


@query(
    "new_events",
    with_("logs")
    + "SELECT host, count(*) AS n, count(ts) AS timed FROM (SELECT ts, host, raw FROM logs WHERE ts IS NULL UNION ALL"
    " SELECT ts, host, raw FROM logs WHERE ts IS NULL UNION ALL SELECT DISTINCT ts, host, raw FROM logs WHERE ts IS NOT NULL)"
    " GROUP BY host",
)
def new_events(spark, folder):
    """A double delivery: repeats vanish, but rows without a time are kept."""
    events = corpus.log_events(spark, folder)
    fresh = logs.new_events(events.unionByName(events), None, "event_id")
    return fresh.groupBy("host").agg(F.count("*").alias("n"), F.count("ts").alias("timed"))


@ints("rank")
@query(
    "query_logs",
    with_("lhits")
    + "SELECT request_id, rank, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, host, event_type FROM lhits",
)
def query_logs(spark, folder):
    """Newest visible events of every log question."""
    _, found = _log_hits(spark, folder)
    return found.select("request_id", "rank", "event_id", _stamp("ts"), "host", "event_type")


def _log_hits(spark, folder):
    requests, _ = logs.valid_since(corpus.log_requests(spark, folder))
    return requests, logs.query_logs(
        corpus.log_events(spark, folder), corpus.hosts(spark, folder), requests
    )


@query(
    "record_blocks",
    with_("lreqs", "lhits")
    + "SELECT r.request_id, md5(coalesce('<기록>' || chr(10) || string_agg(coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '시각 미상')"
    " || ' [' || host || '] ' || h.event_type || ' ' || raw, chr(10) ORDER BY rank) || chr(10) || '</기록>',"
    " '해당하는 기록을 찾지 못했다.')) AS block_md5 FROM lreqs r LEFT JOIN lhits h USING (request_id) GROUP BY r.request_id",
)
def record_blocks(spark, folder):
    """One bounded, labelled block of events per log question."""
    requests, _ = logs.valid_since(corpus.log_requests(spark, folder))
    found = logs.query_log_lists(
        corpus.log_events(spark, folder),
        corpus.hosts(spark, folder),
        requests,
        retrieval.record_entry().alias("entry"),
    )
    return retrieval.listed_blocks(found).select(
        "request_id", F.md5("block").alias("block_md5")
    )


@query(
    "since_validation",
    "SELECT event_id AS request_id, event_id % 16 < 5 AS accepted FROM events",
)
def since_validation(spark, folder):
    """Requests with a malformed start are rejected, not answered more widely."""
    request = F.col("event_id")
    shapes = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd"),
        F.date_format("ts", "yyyy-MM-dd HH:mm"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit(None), F.lit("yesterday"), F.lit("2024-13-45 00:00:00"), F.date_format("ts", "yyyy"),
        F.date_format("ts", "yyyy-MM"), F.lit("2024-9-1"), F.lit("T10:00"), F.lit("10:00:00"),
        F.lit("12:3"), F.lit("2024-02-30"), F.lit("2024-01-01T25:00"), F.lit("*"),
    ]
    since = F.element_at(F.array(*shapes), (request % 16 + 1).cast("int"))
    asked = corpus.table(spark, folder, "events").select(
        request.alias("request_id"), since.alias("since")
    )
    good, bad = logs.valid_since(asked)
    return good.select("request_id", F.lit(True).alias("accepted")).unionByName(
        bad.select("request_id", F.lit(False).alias("accepted"))
    )


@query(
    "event_counts",
    with_("people", "logs", "hosts")
    + f"SELECT p.name, e.event_type, CAST(sum(e.n) AS BIGINT) AS event_count, '{LOG_SCOPE_NOTICE}' AS scope"
    " FROM (SELECT host, event_type, count(*) AS n FROM logs GROUP BY ALL) e JOIN hosts h ON h.name = e.host"
    f" JOIN people p ON {vis('h', 'p')} GROUP BY ALL",
)
def event_counts(spark, folder):
    """Events each principal may count, with the constant scope notice."""
    return logs.event_counts(
        corpus.log_events(spark, folder),
        corpus.hosts(spark, folder),
        corpus.principals(spark, folder),
    )


@query(
    "log_scope_audit",
    with_("lhits", "lreqs") + "SELECT count(*) AS rows, 0::BIGINT AS out_of_scope, 0::BIGINT AS off_filter FROM lhits",
)
def log_scope_audit(spark, folder):
    """Do type, start or limit ever widen what a principal sees?"""
    requests, found = _log_hits(spark, folder)
    asked = requests.select(
        "request_id", F.col("event_type").alias("asked_type"), "since_ts", "limit"
    )
    rows = found.join(asked, "request_id")
    scope = audits.out_of_scope(rows).agg(F.count("*").alias("out_of_scope"))
    wrong = (
        (F.coalesce(F.col("asked_type") != F.col("event_type"), F.lit(False)))
        | F.coalesce(~(F.col("ts") >= F.col("since_ts")), F.col("since_ts").isNotNull())
        | (F.col("rank") > F.greatest(F.lit(1), "limit"))
    )
    total = rows.agg(F.count("*").alias("rows"), F.count_if(wrong).alias("off_filter"))
    return total.withColumn("one", F.lit(1)).join(scope.withColumn("one", F.lit(1)), "one").drop("one")


@query(
    "log_completeness_audit",
    with_("classes", "logs", "hosts")
    + "SELECT k.clearance || '|' || k.department AS class_key, least(count(*), 50) AS expected, least(count(*), 50) AS answered"
    f" FROM logs e JOIN hosts h ON h.name = e.host JOIN classes k ON {vis('h', 'k')} GROUP BY ALL",
)
def log_completeness_audit(spark, folder):
    """Visible old rows survive newer hidden ones: every class gets its full answer."""
    people = corpus.principals(spark, folder)
    classes = entitlements.principal_classes(people)
    asked = classes.select(
        F.col("class_key").alias("request_id"),
        "department",
        "clearance",
        "class_key",
        F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("timestamp").alias("since_ts"),
        F.lit(50).alias("limit"),
    )
    events, hosts = corpus.log_events(spark, folder), corpus.hosts(spark, folder)
    answered = (
        logs.query_logs(events, hosts, asked)
        .groupBy(F.col("request_id").alias("class_key"))
        .agg(F.count("*").alias("answered"))
    )
    per_class = (
        logs.event_counts(
            events, hosts, classes.withColumn("name", F.col("class_key")), notice=False
        )
        .groupBy(F.col("name").alias("class_key"))
        .agg(F.least(F.sum("event_count"), F.lit(50)).alias("expected"))
    )
    return per_class.join(answered, "class_key", "left")


@query(
    "log_corpus_checks",
    with_("logs", "hosts", "classes")
    + "SELECT 'unregistered_hosts' AS check, count(DISTINCT host) AS value FROM logs WHERE host NOT IN (SELECT name FROM hosts)"
    " UNION ALL SELECT 'event_types', count(DISTINCT event_type) FROM logs"
    " UNION ALL SELECT 'classes_below_limit', count(*) FROM (SELECT k.department, k.clearance, count(e.event_id) AS n FROM classes k"
    f" JOIN hosts h ON {vis('h', 'k')} LEFT JOIN logs e ON e.host = h.name GROUP BY ALL) WHERE n < 20"
    " UNION ALL SELECT 'newest_hidden_from_lowest', count(*) FROM (SELECT * FROM logs ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 25) e"
    " LEFT JOIN hosts h ON h.name = e.host WHERE coalesce(h.required_clearance, 99) > 1",
)
def log_corpus_checks(spark, folder):
    """Conditions on the log corpus without which leak audits prove nothing."""
    return audits.log_corpus_checks(
        corpus.log_events(spark, folder),
        corpus.hosts(spark, folder),
        corpus.principals(spark, folder),
    )


# ----------------------------------------------------------------- streams


def _line_files(spark, folder):
    """The log lines written as text files, one folder of files per day."""
    path = scratch_path(spark, "lines")
    corpus.syslog_lines(spark, folder).select("file", "value").repartition("file").write.partitionBy(
        "file"
    ).text(path)
    return path


@query(
    "read_syslog",
    with_("lines") + "SELECT file, count(*) AS n, count(DISTINCT value) AS different FROM lines GROUP BY file",
)
def read_syslog(spark, folder):
    """Log lines through text files; the file a line came from is known."""
    lines = readers.read_syslog(spark, _line_files(spark, folder) + "/*")
    day = F.regexp_extract("file", r"file=([^/]+)/", 1)
    return lines.groupBy(day.alias("file")).agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("different")
    )


@query(
    "stream_log_load",
    with_("parsed", "refused")
    + "SELECT file, event_type, count(*) AS n FROM parsed WHERE ts IS NOT NULL AND file NOT IN (SELECT file FROM refused)"
    " GROUP BY ALL",
)
def stream_log_load(spark, folder):
    """Files loaded as they arrive, then delivered a second time: nothing is added."""
    source = _line_files(spark, folder)
    out, state = scratch_path(spark, "events"), scratch_path(spark, "state")
    hosts = corpus.hosts(spark, folder)
    # A fresh checkpoint makes the second run see every file as new again.
    for delivery in (1, 2):
        lines = readers.stream_syslog(spark, source + "/*")
        log_stream.load_logs(
            lines, hosts, corpus.YEAR, out, f"{state}-{delivery}"
        ).awaitTermination()
    return _loaded(spark, out)


def _loaded(spark, out):
    loaded = log_stream.events(spark, out)
    day = F.regexp_extract("file", r"file=([^/]+)/", 1)
    return loaded.groupBy(day.alias("file"), "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_restart",
    with_("parsed", "refused")
    + "SELECT file, event_type, count(*) AS n FROM parsed WHERE ts IS NOT NULL AND file NOT IN (SELECT file FROM refused)"
    " GROUP BY ALL",
)
def stream_restart(spark, folder):
    """Two halves of the days, each loaded by a stream with a checkpoint of its
    own: what the first one stored is still there."""
    source = _line_files(spark, folder)
    out, state = scratch_path(spark, "events"), scratch_path(spark, "state")
    hosts = corpus.hosts(spark, folder)
    for half in ("[0-2][0-9]", "3[01]"):
        lines = readers.stream_syslog(spark, f"{source}/file=*-{half}")
        log_stream.load_logs(
            lines, hosts, corpus.YEAR, out, f"{state}-{half[0]}"
        ).awaitTermination()
    return _loaded(spark, out)


@query(
    "stream_cleared_checkpoint",
    with_("parsed", "refused")
    + "SELECT file, event_type, count(*) AS n FROM parsed WHERE ts IS NOT NULL AND file NOT IN (SELECT file FROM refused)"
    " GROUP BY ALL",
)
def stream_cleared_checkpoint(spark, folder):
    """Half of the days, then a cleared checkpoint at the same path and all of
    them: what was stored stays, and nothing is stored twice."""
    source = _line_files(spark, folder)
    out, state = scratch_path(spark, "events"), scratch_path(spark, "state")
    hosts = corpus.hosts(spark, folder)
    for days in ("[0-2][0-9]", "*"):
        lines = readers.stream_syslog(spark, f"{source}/file=*-{days}")
        log_stream.load_logs(lines, hosts, corpus.YEAR, out, state).awaitTermination()
        files.remove(spark, state)
    return _loaded(spark, out)


@query(
    "stream_deduplicated",
    with_("parsed")
    + "SELECT event_type, count(*) AS n FROM parsed WHERE ts IS NOT NULL GROUP BY event_type",
)
def stream_deduplicated(spark, folder):
    """Every line arrives twice in a stream; state keeps one within the watermark."""
    path = scratch_path(spark, "doubled")
    lines = corpus.syslog_lines(spark, folder).select("file", "value")
    lines.unionByName(lines).write.parquet(path)
    arriving = spark.readStream.schema("file string, value string").parquet(path)
    out = scratch_path(spark, "unique")
    (
        log_stream.deduplicated(arriving, corpus.YEAR, "40 days")
        .writeStream.option("checkpointLocation", scratch_path(spark, "state"))
        .trigger(availableNow=True)
        .start(out, format="parquet")
        .awaitTermination()
    )
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


def _quota_requests(spark, folder):
    return corpus.table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("user"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def _exempt(spark, folder):
    return (
        corpus.table(spark, folder, "events")
        .select(F.concat(F.lit("u"), (F.col("user_id") % 2) * 3).alias("user"))
        .distinct()
    )


_QUOTA = (
    "SELECT request_id, usr AS user, day, CASE WHEN exempt OR n <= 10 THEN true ELSE false END AS allowed,"
    " CASE WHEN exempt THEN NULL ELSE greatest(0, 10 - n) END AS remaining FROM (SELECT event_id AS request_id,"
    " 'u' || (user_id % 20) AS usr, strftime(ts, '%Y-%m-%d') AS day, user_id % 20 IN (0, 3) AS exempt, row_number() OVER"
    " (PARTITION BY user_id % 20, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)"
)


@ints("remaining")
@query("daily_quota", _QUOTA)
def daily_quota(spark, folder):
    """Which requests a user's daily quota lets through, and what remains."""
    from clearsift.operators.access_log import daily_quota as quota

    verdicts = quota(_quota_requests(spark, folder), _exempt(spark, folder))
    return verdicts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@ints("remaining")
@query("stream_quota", _QUOTA)
def stream_quota(spark, folder):
    """The same verdicts over arriving requests, with one counter per user and day."""
    path, out = scratch_path(spark, "requests"), scratch_path(spark, "verdicts")
    _quota_requests(spark, folder).write.parquet(path)
    arriving = spark.readStream.schema("request_id long, user string, ts timestamp").parquet(path)
    (
        access_stream.daily_quota(arriving, cut(_exempt(spark, folder)))
        .writeStream.option("checkpointLocation", scratch_path(spark, "state"))
        .trigger(availableNow=True)
        .start(out, format="parquet")
        .awaitTermination()
    )
    return spark.read.parquet(out).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "stream_access_records",
    with_("access")
    + "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, count(*) FILTER (NOT allowed) AS blocked FROM access GROUP BY ALL",
)
def stream_access_records(spark, folder):
    """Access records appended to day partitions as they arrive."""
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "records")
    records = corpus.access_records(spark, folder)
    records.write.parquet(path)
    arriving = spark.readStream.schema(records.schema).parquet(path)
    access_stream.append_records(arriving, out, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("blocked")
    )


@query(
    "event_types_present",
    with_("parsed")
    + "SELECT t AS event_type, coalesce(n, 0) AS n FROM (SELECT unnest(['auth_failure','session_open','session_close',"
    "'privilege_use','access_denied','other']) AS t) LEFT JOIN (SELECT event_type, count(*) AS n FROM parsed WHERE ts IS NOT NULL"
    " GROUP BY event_type) ON event_type = t",
)
def event_types_present(spark, folder):
    """Every known event type with its count, absent ones included."""
    counts = (
        _parsed(spark, folder)
        .where(F.col("ts").isNotNull())
        .groupBy("event_type")
        .agg(F.count("*").alias("n"))
    )
    known = spark.createDataFrame([(t,) for t in EVENT_TYPES], "event_type string")
    return known.join(counts, "event_type", "left").select(
        "event_type", F.coalesce("n", F.lit(0)).alias("n")
    )
