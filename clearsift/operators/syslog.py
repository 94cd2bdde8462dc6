"""System log lines to typed events, as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.scale import with_fields


def parse_syslog(lines: DataFrame, year, line_col: str = "value") -> DataFrame:
    """Add ts, host, process, event_type, principal_name, raw and severity.

    The format has no year, so the caller names it (a number or a column).
    Lines of another format, or with an impossible date, get a null ``ts``.
    """
    year = F.lit(year) if isinstance(year, int) else year
    group = lambda n: F.regexp_extract("raw", C.SYSLOG_LINE, n)
    stamp = F.concat_ws(" ", year.cast("string"), group(1), group(2), group(3))
    split = with_fields(
        lines.withColumn("raw", F.regexp_replace(line_col, r"\n+\z", "")),
        F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss")).alias("ts"),
        group(4).alias("host"),
        group(5).alias("process"),
        group(7).alias("__message"),
    )
    event_type, who = classify("__message")
    return with_fields(
        split, event_type.alias("event_type"), who.alias("principal_name")
    ).select(
        *lines.columns,
        "ts",
        "host",
        "process",
        "event_type",
        "principal_name",
        "raw",
        F.lit(None).cast("string").alias("severity"),
    )


def classify(message) -> tuple[Column, Column]:
    """Event type and user by the first pattern the message holds."""
    message = F.col(message) if isinstance(message, str) else message
    event_type = who = None
    for name, pattern in C.EVENT_PATTERNS:
        found = message.rlike(pattern)
        user = F.regexp_extract(message, pattern, 1)
        if event_type is None:
            event_type, who = F.when(found, name), F.when(found, user)
        else:
            event_type, who = event_type.when(found, name), who.when(found, user)
    return event_type.otherwise(C.DEFAULT_EVENT_TYPE), who


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, skipped lines)."""
    return parsed.where(F.col("ts").isNotNull()), parsed.where(F.col("ts").isNull())
