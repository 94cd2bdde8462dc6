"""The product's tables, derived by Spark from a folder of parquet tables.

Permissions, requests and logs do not exist there, so plain rules over keys
supply them: customers become principals, documents and embeddings become the
corpus, events become requests, log lines and access records, and
conversations become sessions and answers.
"""

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.functions.access import class_key
from clearsift.functions.scale import broadcast_if_small, cut, scratch_path, spread
from clearsift.operators.embedding import encode
from clearsift.operators.keyword_search import postings
from clearsift.operators.parsing import chunk_rows
from clearsift.sources.inverted import InvertedTable, write_inverted

# Department names of the source tables.
DEPARTMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TOPICS = 10
# Parts of a document or conversation are numbered below this, which no text
# within Spark's limits reaches in windows of 750 characters.
PARTS = 1 << 22
HASH_DIM = 64
# Words whose places a task remembers.
PLACES = 500_000
SEVERAL = 3
YEAR = 2024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customer_name(key) -> F.Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def department(number) -> F.Column:
    names = F.array(*[F.lit(d) for d in DEPARTMENTS])
    return F.element_at(names, (number % len(DEPARTMENTS) + 1).cast("int"))


def departments_by(number) -> F.Column:
    """All three spellings of access: a list, an empty list, and null."""
    quarter = F.floor(number / 4)
    none = F.array().cast("array<string>")
    return (
        F.when(number % 8 == 0, F.array(department(quarter), department(quarter + 2)))
        .when(number % 4 == 0, F.array(department(quarter)))
        .when(number % 4 == 1, none)
    )


# ------------------------------------------------------------- dimensions


def principals(spark, folder) -> DataFrame:
    roles = F.array(F.lit("member"), F.lit("auditor"), F.lit("developer"))
    return table(spark, folder, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("department"),
        (F.col("c_nationkey") % 3 + 1).cast("int").alias("clearance"),
        F.element_at(roles, (F.col("c_custkey") % 3 + 1).cast("int")).alias("role"),
    )


def hosts(spark, folder) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.concat(F.lit("host-"), n).alias("name"),
        department(n).alias("department"),
        (n % 3 + 1).cast("int").alias("required_clearance"),
        departments_by(n).alias("allowed_departments"),
    )


# ----------------------------------------------------------------- corpus


def raw_documents(spark, folder) -> DataFrame:
    """Documents with their text; ``src`` is the number of the source."""
    doc = F.col("doc_id")
    doc_type = F.when(F.col("lang") == "en", "md").otherwise("pdf")
    return table(spark, folder, "documents").select(
        doc.alias("document_id"),
        F.concat_ws(" ", "source", "lang", doc).alias("title"),
        F.concat(F.col("source"), F.lit("/"), doc, F.lit("."), doc_type).alias("source_path"),
        doc_type.alias("doc_type"),
        (doc % 3 + 1).cast("int").alias("required_clearance"),
        departments_by(doc).alias("allowed_departments"),
        F.substring("source", 4, 10).cast("int").alias("src"),
        "text",
    )


def documents(spark, folder) -> DataFrame:
    return raw_documents(spark, folder).drop("text", "src")


def clauses(spark, folder) -> DataFrame:
    """One clause per document; several documents of a source share a code."""
    doc = F.col("document_id")
    code = F.concat_ws(".", F.lit("1"), F.col("src") + 1, doc % 40)
    return raw_documents(spark, folder).select(
        doc.alias("clause_id"),
        "document_id",
        code.alias("code"),
        F.concat(F.lit("Section "), code).alias("title"),
    )


def clause_of(doc) -> F.Column:
    """Every fifth document lies outside any clause."""
    return F.when(doc % 5 != 0, doc)


def text_chunks(spark, folder) -> DataFrame:
    """All documents in overlapping windows, with titles and permissions."""
    docs = spread(raw_documents(spark, folder), "document_id")
    doc = F.col("document_id")
    code = F.concat_ws(".", F.lit("1"), F.col("src") + 1, doc % 40)
    rows = docs.select(
        "document_id",
        clause_of(doc).alias("clause_id"),
        F.when(doc % 5 != 0, code).alias("clause_code"),
        F.col("title").alias("doc_title"),
        "required_clearance",
        "allowed_departments",
        "text",
    )
    return chunk_rows(rows).withColumn("chunk_id", doc * PARTS + F.col("ordinal"))


CHUNK_KEYS = ["chunk_id", "document_id", "clause_id", "required_clearance", "allowed_departments"]


def encoded_chunks(spark, folder, keep=CHUNK_KEYS) -> DataFrame:
    return encode(
        text_chunks(spark, folder), "text", "passage", hash_encoder, HASH_DIM, keep=keep
    )


def stored_chunks(spark, folder) -> DataFrame:
    """Chunks with text and vector, written once: search and hydration read them."""
    return cut(encoded_chunks(spark, folder, [*CHUNK_KEYS, "clause_code", "doc_title", "text"]))


def stored_index(spark, folder) -> InvertedTable:
    """The inverted table as files with a dictionary, as a search finds it."""
    text = text_chunks(spark, folder).select("chunk_id", "clause_code", "doc_title", "text")
    return write_inverted(postings(text), scratch_path(spark, "inverted"))


def vector_chunks(spark, folder) -> DataFrame:
    """The given embeddings as chunks of the documents, dealt by number: there
    may be more of them than documents."""
    doc = F.col("document_id")
    many = table(spark, folder, "documents").count()
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        (F.col("vec_id") % many).alias("document_id"),
        "embedding",
        "label",
    )
    return vectors.join(documents(spark, folder), "document_id").select(
        "chunk_id",
        "document_id",
        clause_of(doc).alias("clause_id"),
        "label",
        "embedding",
        "required_clearance",
        "allowed_departments",
    )


def topics(spark, folder) -> DataFrame:
    """One query vector per label: the mean of its embeddings."""
    parts = (
        table(spark, folder, "embeddings")
        .select(F.col("label").cast("long").alias("query_id"), F.posexplode("embedding"))
        .groupBy("query_id", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("value"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return parts.groupBy("query_id").agg(
        F.transform(ordered, lambda p: p["value"]).alias("vector")
    )


# --------------------------------------------------------------- requests


def users(spark, folder) -> int:
    """Number of customers: every one of them can ask."""
    return table(spark, folder, "customer").count()


def user_of(event, user, many: int) -> F.Column:
    """The customer behind an event, so that all customers ask."""
    return customer_name((user + event * 151) % many)


def with_classes(requests: DataFrame, people: DataFrame) -> DataFrame:
    """Requests with their principal's class; an unknown persona fails the job."""
    known = people.select(
        F.col("name").alias("persona"),
        "department",
        "clearance",
        class_key("department", "clearance").alias("class_key"),
    )
    found = F.when(F.col("class_key").isNull(), F.raise_error(F.lit("unknown persona")))
    return requests.join(broadcast_if_small(known), "persona", "left").withColumn(
        "class_key", F.coalesce("class_key", found)
    )


def topic_requests(spark, folder) -> DataFrame:
    """Every event is a search of its user for a topic."""
    asked = spread(table(spark, folder, "events"), "event_id").select(
        F.col("event_id").alias("request_id"),
        user_of(F.col("event_id"), F.col("user_id"), users(spark, folder)).alias("persona"),
        (F.col("event_id") % TOPICS).alias("query_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("topic "), F.col("event_id") % TOPICS).alias("query"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("s"), F.col("user_id") % 7)).alias(
            "session_id"
        ),
    )
    return with_classes(asked, principals(spark, folder))


def session_requests(spark, folder) -> DataFrame:
    """Every user turn of a conversation is a search within its session."""
    asked = (
        table(spark, folder, "conversations")
        .where(F.col("role") == "user")
        .select(
            (F.col("conv_id") * PARTS + F.col("turn")).alias("request_id"),
            F.col("conv_id").alias("session_id"),
            F.col("turn").alias("call_no"),
            customer_name(F.col("conv_id") % users(spark, folder)).alias("persona"),
            ((F.col("conv_id") + F.col("turn")) % TOPICS).alias("query_id"),
        )
    )
    return with_classes(asked, principals(spark, folder))


def text_queries(spark, folder) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def text_personas(spark, folder) -> DataFrame:
    """The personas each text query is asked by."""
    item = F.col("item_id")
    many = users(spark, folder)
    names = [customer_name((item * 7 + j * 11) % many) for j in range(SEVERAL)]
    return table(spark, folder, "benchmark").select(
        item.alias("query_id"), F.array(*names).alias("names")
    )


def text_requests(spark, folder) -> DataFrame:
    """Benchmark passages as questions of several personas each."""
    asked = text_personas(spark, folder).select(
        "query_id", F.posexplode("names").alias("persona_no", "persona")
    )
    requests = text_queries(spark, folder).join(asked, "query_id").withColumn(
        "request_id", F.col("query_id") * 10 + F.col("persona_no")
    )
    return with_classes(requests, principals(spark, folder))


def encoded_queries(spark, folder) -> DataFrame:
    """query_id, query and vector of every benchmark passage."""
    queries = text_queries(spark, folder)
    return encode(
        queries.withColumn("asked", F.col("query")), "asked", "query", hash_encoder, HASH_DIM
    ).withColumnRenamed("embedding", "vector")


_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


class _Places(dict):
    """The place of a word, behind all others if its sign is negative."""

    def __missing__(self, word):
        if len(self) >= PLACES:
            self.clear()
        number = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        place = self[word] = number % HASH_DIM + HASH_DIM * (number // HASH_DIM % 2)
        return place


_PLACES = _Places()


def hash_encoder(texts) -> np.ndarray:
    """A stand-in for a model: signed feature hashing of words."""
    found = [[_PLACES[word] for word in _WORD.findall(text.lower())] for text in texts]
    row = np.repeat(np.arange(len(texts)), [len(places) for places in found])
    flat = np.array([place for places in found for place in places], dtype=np.int64)
    times = np.bincount(row * 2 * HASH_DIM + flat, minlength=len(texts) * 2 * HASH_DIM)
    times = times.reshape(len(texts), 2 * HASH_DIM).astype(np.float64)
    return times[:, :HASH_DIM] - times[:, HASH_DIM:]


# ------------------------------------------------------------------- logs


def host_of(user, day) -> F.Column:
    """Users work on one host; on every fifth day some use unregistered ones."""
    stray = (day % 5 == 0) & (user % 27 >= 25)
    return F.concat(F.lit("host-"), F.when(stray, user % 27).otherwise(user % 25))


def log_events(spark, folder) -> DataFrame:
    """Events as log rows; some have no time."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 997 != 0, ts).alias("ts"),
        host_of(F.col("user_id"), F.dayofmonth("ts")).alias("host"),
        F.lit("app").alias("process"),
        "event_type",
        F.concat(F.lit("u"), "user_id").alias("principal_name"),
        F.col("props").alias("raw"),
    )


def log_requests(spark, folder) -> DataFrame:
    """Every event is also a log question: a type or any, a start or none."""
    kinds = F.array(*[F.lit(k) for k in ("signup", "error", "click", "view", "purchase")])
    event = F.col("event_id")
    asked = spread(table(spark, folder, "events"), "event_id").select(
        event.alias("request_id"),
        user_of(F.col("event_id"), F.col("user_id"), users(spark, folder)).alias("persona"),
        F.when(event % 101 == 0, "*")
        .when(event % 6 != 5, F.element_at(kinds, (event % 6 + 1).cast("int")))
        .alias("event_type"),
        F.when(event % 4 != 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("since"),
        (event % 60).cast("int").alias("limit"),
    )
    return with_classes(asked, principals(spark, folder))


def syslog_lines(spark, folder) -> DataFrame:
    """Events as system log lines, one file per day, in nine message shapes."""
    event, user = F.col("event_id"), F.concat(F.lit("u"), "user_id")
    shapes = [
        F.concat(F.lit("Failed password for invalid user "), user, F.lit(" from 10.0.0.1 port 22")),
        F.concat(F.lit("Failed password for "), user, F.lit(" from 10.0.0.1 port 22 ssh2")),
        F.concat(F.lit("pam_unix: authentication failure; rhost=x user="), user),
        F.concat(F.lit("Accepted publickey for "), user, F.lit(" from 10.0.0.2")),
        F.concat(F.lit("pam_unix(sshd:session): session opened for user "), user),
        F.concat(F.lit("pam_unix(sshd:session): session closed for user "), user),
        F.concat(F.lit(" "), user, F.lit(" : TTY=pts/1 ; PWD=/srv ; USER=root")),
        F.concat(F.lit("Permission denied on /srv for user "), user),
        F.concat(F.lit("(root) CMD (backup "), F.col("props"), F.lit(")")),
    ]
    message = F.element_at(F.array(*shapes), (event % len(shapes) + 1).cast("int"))
    line = F.concat(
        F.date_format("ts", "MMM "),
        F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
        F.date_format("ts", " HH:mm:ss "),
        host_of(F.col("user_id"), F.dayofmonth("ts")),
        F.lit(" sshd["),
        event,
        F.lit("]: "),
        message,
    )
    broken = F.when(event % 31 == 0, F.concat(F.lit("Feb 30"), F.substring(line, 7, 200)))
    return spread(table(spark, folder, "events"), "event_id").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("file"),
        F.coalesce(broken, line).alias("value"),
    )


# ----------------------------------------------------------------- access


def access_records(spark, folder) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    rows = table(spark, folder, "events").select(
        event.alias("record_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        user_of(event, user, users(spark, folder)).alias("persona"),
        F.concat(F.lit("topic "), event % TOPICS).alias("query"),
        F.when(event % 3 != 0, F.concat_ws(".", F.lit("1"), user % 20 + 1, event % 40)).alias(
            "clause_code"
        ),
        F.when(event % 2 == 0, "chunk").otherwise("log_event").alias("resource_kind"),
        (event % 700).alias("resource_id"),
        (F.col("event_type") != "error").alias("allowed"),
        F.when(user % 7 != 0, F.concat(F.lit("s"), user % 7)).alias("session_id"),
    )
    return with_classes(rows, principals(spark, folder)).drop("class_key")


def answers(spark, folder) -> DataFrame:
    """Assistant turns with citations: bracketed, bare, and a date."""
    conv, turn = F.col("conv_id"), F.col("turn")
    code = lambda a, b: F.concat_ws(".", F.lit("1"), a, b)
    return (
        table(spark, folder, "conversations")
        .where(F.col("role") == "assistant")
        .select(
            (conv * PARTS + turn).alias("answer_id"),
            F.concat(
                "text",
                F.lit(" See "),
                code(conv % 20 + 1, (conv * 3 + turn) % 40),
                F.lit(" and ["),
                code((conv * 3 + 1) % 20 + 1, (conv * 3 + 1) % 40),
                F.lit("], ["),
                code(turn % 20 + 1, conv % 40),
                F.lit("] of 2026.09.04."),
            ).alias("answer"),
        )
    )


def answer_hits(spark, folder) -> DataFrame:
    """What each answer's searches had retrieved."""
    conv, turn = F.col("conv_id"), F.col("turn")
    asked = (
        table(spark, folder, "conversations")
        .where(F.col("role") == "assistant")
        .select(
            (conv * PARTS + turn).alias("answer_id"),
            F.explode(F.sequence(conv * 3, conv * 3 + 4)).alias("document_id"),
        )
    )
    coded = clauses(spark, folder).select("document_id", F.col("code"))
    return asked.join(coded, "document_id").select(
        "answer_id",
        F.col("document_id").alias("chunk_id"),
        F.when(F.col("document_id") % 5 != 0, F.col("code")).alias("clause_code"),
    )
