"""System logs arriving as files, loaded continuously."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from clearsift.functions.scale import cut
from clearsift.operators.logs import accepted_events, load_report, unregistered_hosts
from clearsift.operators.syslog import parse_syslog
from clearsift.streaming.ledger import Ledger, attempt_folder, fingerprint, writer_of

EVENT_COLUMNS = [
    "file",
    "ts",
    "host",
    "process",
    "event_type",
    "principal_name",
    "raw",
    "severity",
]
EVENT_SCHEMA = (
    "file string, ts timestamp, host string, process string, event_type string,"
    " principal_name string, raw string, severity string, dt date"
)
REPORT_SCHEMA = "file string, parsed long, skipped long, inserted long, refused boolean"


def load_logs(
    lines: DataFrame,
    hosts: DataFrame,
    year: int,
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Load every file that has arrived under ``(file, value)`` lines.

    Whole files are refused when they name an unregistered host; their lines go
    to ``refused``.  Repeats are dropped inside the batch and against what is
    stored for the same days, so a file delivered again adds nothing however
    late it comes.

    ``out`` has a ledger: a batch is stored once its entry is there, by the id
    inside ``checkpoint``.  A retried batch is not stored again; a checkpoint
    that was cleared, or a new one, adds to what is there.  A stream started over
    the same ``out`` takes over, and the one before is refused at its next batch,
    as is a batch that the ledger and the checkpoint disagree on.  ``events``,
    ``reports`` and ``refused`` read what is committed.
    """
    spark = lines.sparkSession
    ledger = Ledger(spark, out)
    epoch = ledger.take_over()

    def load(batch: DataFrame, batch_id: int) -> None:
        writer = writer_of(spark, checkpoint)
        parsed = cut(parse_syslog(batch, year))
        mark = fingerprint(parsed, "file", "value")
        if ledger.done(writer, batch_id, mark):
            return
        attempt, own = attempt_folder(writer, batch_id)
        days = parsed.agg(
            F.min(F.to_date("ts")).alias("low"), F.max(F.to_date("ts")).alias("high")
        ).first()
        held = ledger.read("events", EVENT_SCHEMA).where(F.col("dt").between(days.low, days.high))
        accepted = accepted_events(parsed, hosts, held).select(
            *EVENT_COLUMNS, F.to_date("ts").alias("dt")
        )
        accepted.write.partitionBy("dt").parquet(f"{out}/events/{own}")
        stored = spark.read.schema(EVENT_SCHEMA).parquet(f"{out}/events/{own}")
        load_report(parsed, stored, hosts).write.parquet(f"{out}/report/{own}")
        bad = unregistered_hosts(parsed.where(F.col("ts").isNotNull()), hosts, "file")
        parsed.join(bad.select("file").distinct(), "file", "left_semi").select(
            "file", "value"
        ).write.parquet(f"{out}/refused/{own}")
        ledger.commit(epoch, writer, batch_id, attempt, mark)

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def events(spark: SparkSession, out: str) -> DataFrame:
    """The events stored under ``out``, with their day ``dt``."""
    return Ledger(spark, out).read("events", EVENT_SCHEMA)


def reports(spark: SparkSession, out: str) -> DataFrame:
    """One row for each file of each committed batch."""
    return Ledger(spark, out).read("report", REPORT_SCHEMA)


def refused(spark: SparkSession, out: str) -> DataFrame:
    """The lines of the files that were refused."""
    return Ledger(spark, out).read("refused", "file string, value string")


def deduplicated(lines: DataFrame, year: int, delay: str = "1 day") -> DataFrame:
    """Events of a stream with repeats dropped inside the watermark.

    State is bounded by ``delay``: a repeat arriving later is dropped as late.
    """
    events = parse_syslog(lines, year).where(F.col("ts").isNotNull())
    return (
        events.withColumn("raw_md5", F.md5("raw"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["ts", "host", "raw_md5"])
        .drop("raw_md5")
    )
