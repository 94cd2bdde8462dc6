"""Readers for the input formats.  Missing mandatory fields are errors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.schema import ROLES


class SourceError(Exception):
    """An input file does not say what it must."""


def read_markdown_dir(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, content, modified) of the files in a folder whose name fits
    ``pattern``; none is an error.  Whole texts are not sorted: order by
    ``path`` where an order is wanted."""
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("value").alias("content"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )
    if files.isEmpty():
        raise SourceError(f"no markdown documents in {path}")
    return files


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """Host registry from JSON (an array, or one object per line).

    A missing permission field is an error: absent must not read as open.
    """
    fields = "name string, department string, required_clearance int, allowed_departments array<string>"
    hosts = spark.read.schema(fields).option("mode", "FAILFAST").json(path, multiLine=_is_array(spark, path))
    _require(hosts, ["name", "department", "required_clearance", "allowed_departments"], path)
    return hosts


def read_principals(spark: SparkSession, path: str) -> DataFrame:
    """Principals from JSON; ``role`` defaults to member."""
    fields = "name string, department string, clearance int, role string"
    rows = spark.read.schema(fields).option("mode", "FAILFAST").json(path, multiLine=_is_array(spark, path))
    _require(rows, ["name", "department", "clearance"], path)
    return with_roles(rows)


def with_roles(rows: DataFrame) -> DataFrame:
    named = rows.withColumn("role", F.coalesce("role", F.lit("member")))
    strange = named.where(~F.col("role").isin(*ROLES))
    count = strange.count()
    if count:
        raise SourceError(f"{count} rows with a role other than {', '.join(ROLES)}")
    return named


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries from JSON lines; blank lines are ignored.

    ``clearance`` may be written as a number or a text, ``relevant`` is a set.
    """
    fields = "query string, department string, clearance string, relevant array<string>"
    rows = spark.read.schema(fields).option("mode", "FAILFAST").json(path)
    _require(rows, ["query", "department", "clearance", "relevant"], path)
    return rows.select(
        "query",
        "department",
        F.col("clearance").cast("int").alias("clearance"),
        F.array_distinct("relevant").alias("relevant"),
    )


def read_syslog(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of system log files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def stream_syslog(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """As ``read_syslog`` for files arriving in a folder."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )


def _require(rows: DataFrame, columns, path: str) -> None:
    missing = F.lit(False)
    for column in columns:
        missing = missing | F.col(column).isNull()
    if not rows.where(missing).isEmpty():
        raise SourceError(f"{path}: every entry needs {', '.join(columns)}")


def _is_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").head()
    return first is not None and first.value.lstrip().startswith("[")
