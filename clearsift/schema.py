"""Declared schemas of the stored tables."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_DEPARTMENTS = T.ArrayType(T.StringType())

DOCUMENTS = _struct(
    ("document_id", T.LongType(), False),
    ("title", T.StringType(), False),
    ("source_path", T.StringType(), False),
    ("doc_type", T.StringType(), False),
    ("required_clearance", T.IntegerType(), False),
    ("allowed_departments", _DEPARTMENTS, True),
    ("ingested_at", T.TimestampType(), True),
)
CLAUSES = _struct(
    ("clause_id", T.LongType(), False),
    ("document_id", T.LongType(), False),
    ("code", T.StringType(), False),
    ("title", T.StringType(), False),
    ("text", T.StringType(), False),
)
CHUNKS = _struct(
    ("chunk_id", T.LongType(), False),
    ("document_id", T.LongType(), False),
    ("clause_id", T.LongType(), True),
    ("ordinal", T.IntegerType(), False),
    ("text", T.StringType(), False),
    ("embedding", T.ArrayType(T.FloatType()), False),
)
HOSTS = _struct(
    ("name", T.StringType(), False),
    ("department", T.StringType(), False),
    ("required_clearance", T.IntegerType(), False),
    ("allowed_departments", _DEPARTMENTS, True),
)
LOG_EVENTS = _struct(
    ("event_id", T.LongType(), False),
    ("ts", T.TimestampType(), True),
    ("host", T.StringType(), False),
    ("process", T.StringType(), True),
    ("event_type", T.StringType(), False),
    ("principal_name", T.StringType(), True),
    ("raw", T.StringType(), False),
    ("severity", T.StringType(), True),
)
PRINCIPALS = _struct(
    ("name", T.StringType(), False),
    ("department", T.StringType(), False),
    ("clearance", T.IntegerType(), False),
    ("role", T.StringType(), False),
)
ACCESS_RECORDS = _struct(
    ("ts", T.TimestampType(), False),
    ("persona", T.StringType(), False),
    ("department", T.StringType(), False),
    ("clearance", T.IntegerType(), False),
    ("query", T.StringType(), False),
    ("clause_code", T.StringType(), True),
    ("resource_kind", T.StringType(), False),
    ("resource_id", T.LongType(), False),
    ("allowed", T.BooleanType(), False),
    ("session_id", T.StringType(), True),
)
# Partition column of rows stored by permission signature.
SIGNATURE = "signature"
RECORD_COLUMNS = ACCESS_RECORDS.names
DOC_TYPES = ("pdf", "docx", "md")
ROLES = ("member", "auditor", "developer")
RESOURCE_KINDS = ("chunk", "log_event")
