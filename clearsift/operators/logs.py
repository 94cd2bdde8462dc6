"""Log loading and entitled log queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.access import clamp, class_key
from clearsift.functions.scale import broadcast_if_small, settle, top_k
from clearsift.operators.entitlements import principal_classes, visible_classes

# Full dates and date-times of ISO 8601; anything shorter is refused, since it
# would be completed by a guess.
ISO_TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


def _newest():
    return [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]


# ---------------------------------------------------------------- loading


def unregistered_hosts(events: DataFrame, hosts: DataFrame, file_col: str) -> DataFrame:
    """(file, host) pairs naming hosts the registry does not hold."""
    registered = hosts.select(F.col("name").alias("host"))
    return events.select(file_col, "host").distinct().join(
        broadcast_if_small(registered), "host", "left_anti"
    )


def new_events(
    events: DataFrame, existing: DataFrame | None, order_col: str = "file"
) -> DataFrame:
    """Drop repeats on (ts, host, md5(raw)), inside the input (the first by
    ``order_col`` stays) and against ``existing``; events without a time are
    never repeats."""
    key = ["ts", "host", "raw_md5"]
    hashed = events.withColumn("raw_md5", F.md5("raw"))
    rest = [c for c in hashed.columns if c not in key]
    timed = (
        hashed.where(F.col("ts").isNotNull())
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), order_col).alias("row"))
        .select(*key, "row.*")
    )
    if existing is not None:
        held = existing.where(F.col("ts").isNotNull()).select(
            "ts", "host", F.md5("raw").alias("raw_md5")
        )
        timed = timed.join(held, key, "left_anti")
    return timed.unionByName(hashed.where(F.col("ts").isNull())).select(*events.columns)


def accepted_events(
    parsed: DataFrame, hosts: DataFrame, existing: DataFrame | None, file_col: str = "file"
) -> DataFrame:
    """Rows to insert: files naming an unregistered host are refused whole."""
    events = parsed.where(F.col("ts").isNotNull())
    refused = unregistered_hosts(events, hosts, file_col).select(file_col).distinct()
    clean = events.join(settle(refused), file_col, "left_anti")
    return new_events(clean, existing, file_col)


def load_report(
    parsed: DataFrame, accepted: DataFrame, hosts: DataFrame, file_col: str = "file"
) -> DataFrame:
    """Per file: lines parsed, skipped and inserted, and whether it was refused."""
    refused = (
        unregistered_hosts(parsed.where(F.col("ts").isNotNull()), hosts, file_col)
        .select(file_col, F.lit(True).alias("refused"))
        .distinct()
    )
    lines = parsed.groupBy(file_col).agg(
        F.count("ts").alias("parsed"), F.count_if(F.col("ts").isNull()).alias("skipped")
    )
    inserted = accepted.groupBy(file_col).agg(F.count("*").alias("inserted"))
    return (
        lines.join(inserted, file_col, "left")
        .join(refused, file_col, "left")
        .select(
            file_col,
            "parsed",
            "skipped",
            F.coalesce("inserted", F.lit(0)).alias("inserted"),
            F.coalesce("refused", F.lit(False)).alias("refused"),
        )
    )


# ---------------------------------------------------------------- querying


def valid_since(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse ``since`` texts.  A malformed one rejects its request: dropping
    the filter would answer more than was asked."""
    text = F.col("since")
    # Spark reads fractions after a point only.
    whole = F.when(text.rlike(ISO_TIME), F.replace(text, F.lit(","), F.lit(".")))
    parsed = requests.withColumn("since_ts", F.try_to_timestamp(whole))
    bad = text.isNotNull() & (text != "") & F.col("since_ts").isNull()
    return parsed.where(~F.coalesce(bad, F.lit(False))), parsed.where(bad).select(
        *requests.columns
    )


def query_logs(events: DataFrame, hosts: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest visible events of every request.

    ``requests``: request_id, department, clearance, class_key, event_type
    (null: any), since_ts (null: any), limit (held within 1..50).

    All events of a host and type are visible to the same classes, so the
    newest 50 per (host, type) hold every possible answer: the events are
    reduced in one pass, whatever the number of requests, and only that small
    remainder meets classes and requests.  ``since`` keeps a prefix of the
    newest-first order, so it applies after ranking without changing results.
    Events of unregistered hosts are visible to no one (inner join).
    """
    asked, ranked = _asked_and_ranked(events, hosts, requests)
    return (
        asked.join(settle(ranked), _LIST)
        .where((F.col("rank") <= F.col("limit")) & _in_time(F.col("ts")))
        .drop(*_LIST, "since_ts", "limit")
    )


def query_log_lists(
    events: DataFrame, hosts: DataFrame, requests: DataFrame, *columns
) -> DataFrame:
    """As ``query_logs``, but one row per request, with its events in order as
    ``events``, structs of rank, ts and these columns; empty where there are none.

    A list of at most 50 events is made once for each class and type and sent to
    the requests, which take their part of it: nothing of a request is shuffled.
    """
    asked, ranked = _asked_and_ranked(events, hosts, requests)
    listed = ranked.groupBy(*_LIST).agg(
        F.sort_array(F.collect_list(F.struct("rank", "ts", *columns))).alias("events")
    )
    wanted = lambda e: (e["rank"] <= F.col("limit")) & _in_time(e["ts"])
    found = F.filter("events", lambda e: F.coalesce(wanted(e), F.lit(False)))
    return (
        asked.join(settle(listed), _LIST, "left")
        .withColumn("events", F.coalesce(found, F.array().cast(listed.schema["events"].dataType)))
        .drop(*_LIST, "since_ts", "limit")
    )


# What a list of newest events is made for.
_LIST = ["class_key", "any_type", "asked_type"]


def _in_time(ts):
    return F.col("since_ts").isNull() | (ts >= F.col("since_ts"))


def _asked_and_ranked(events: DataFrame, hosts: DataFrame, requests: DataFrame):
    """Requests with the list they ask for, and the newest events of each list."""
    newest = top_k(events, ["host", "event_type"], _newest(), C.MAX_LOG_LIMIT, "__n").drop("__n")
    registry = hosts.select(
        F.col("name").alias("host"), "required_clearance", "allowed_departments"
    )
    scoped = visible_classes(registry, principal_classes(requests))
    seen = newest.join(broadcast_if_small(scoped), "host")
    # "Any type" is a flag of its own: no type's name can stand for it.
    kinds = F.array(
        F.struct(F.lit(False).alias("any_type"), F.col("event_type").alias("asked_type")),
        F.struct(F.lit(True).alias("any_type"), F.lit("").alias("asked_type")),
    )
    ranked = top_k(
        seen.select("*", F.inline(kinds)),
        ["class_key", "any_type", "asked_type"],
        _newest(),
        C.MAX_LOG_LIMIT,
    )
    asked = requests.select(
        "request_id",
        "department",
        "clearance",
        "class_key",
        F.col("event_type").isNull().alias("any_type"),
        F.coalesce("event_type", F.lit("")).alias("asked_type"),
        "since_ts",
        clamp("limit", 1, C.MAX_LOG_LIMIT).alias("limit"),
    )
    return asked, ranked


def event_counts(
    events: DataFrame, hosts: DataFrame, principals: DataFrame, notice: bool = True
) -> DataFrame:
    """Events per principal and type, only over hosts each may see.

    Counted per host first.  The constant scope notice is attached whatever
    the counts are.
    """
    per_host = events.groupBy("host", "event_type").agg(F.count("*").alias("n"))
    registry = hosts.select(
        F.col("name").alias("host"), "required_clearance", "allowed_departments"
    )
    classes = principal_classes(principals)
    per_class = (
        per_host.join(broadcast_if_small(visible_classes(registry, classes)), "host")
        .groupBy("class_key", "event_type")
        .agg(F.sum("n").alias("event_count"))
    )
    named = principals.select("name", class_key("department", "clearance").alias("class_key"))
    counted = named.join(settle(per_class), "class_key").drop("class_key")
    return counted.withColumn("scope", F.lit(C.LOG_SCOPE_NOTICE)) if notice else counted
