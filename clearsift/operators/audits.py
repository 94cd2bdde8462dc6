"""Leak audits over result tables: each returns rows that show a leak, or the
figures that would."""

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.access import access_keys, class_key, visible
from clearsift.functions.scale import broadcast_if_small
from clearsift.operators.entitlements import class_sets, principal_classes

# Rows of result lists that one task sorts.
SORTED_ROWS = 1_000_000


def result_counts(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per request, zero included."""
    counts = hits.groupBy("request_id").agg(F.count("*").alias("n"))
    return requests.join(counts, "request_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def count_spread(counts: DataFrame, by) -> DataFrame:
    """Smallest and largest result per query (or per principal); they must agree.

    Across principals of one query this shows clearance; across queries of one
    principal it shows filtering after ranking.
    """
    return counts.groupBy(*by).agg(
        F.min("n").alias("fewest"),
        F.max("n").alias("most"),
        (F.min("n") == F.max("n")).alias("equal"),
    )


def order_conflicts(hits: DataFrame) -> DataFrame:
    """Per query: rows breaking one common order of its chunks.

    All result lists of a query must follow a single total order (distance,
    then chunk id).  Then any two principals keep the relative order of the
    chunks both see, without comparing principals pair by pair.  Lists are sorted
    in parts of about ``SORTED_ROWS`` rows, however many there are.
    """
    parts = hits.count() // SORTED_ROWS + 1
    least = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = hits.select("request_id", "query_id", "chunk_id", "rank", "distance").repartition(
        max(parts, least), "request_id"
    )
    in_list = Window.partitionBy("request_id").orderBy("rank")
    place = F.struct("distance", "chunk_id")
    inversions = (
        lists.withColumn("previous", F.lag(place).over(in_list))
        .groupBy("query_id")
        .agg(
            F.count_if(F.col("previous") >= place).alias("inversions"),
            F.count("*").alias("rows"),
        )
    )
    unstable = (
        hits.groupBy("query_id", "chunk_id")
        .agg((F.min("distance") != F.max("distance")).alias("differs"))
        .groupBy("query_id")
        .agg(F.count_if("differs").alias("unstable_chunks"))
    )
    return inversions.join(unstable, "query_id")


class Candidates:
    """Chunks that the scorer of a search is given for each class, counted in the
    plan of that search: where its rows enter the scorer, not beside it."""

    MOST_CLASSES = 500

    def __init__(self):
        self.seen, self.keys = Observation(), None

    def observe(self, seen: DataFrame, class_keys: list[str] | None) -> DataFrame:
        """``seen`` (with ``class_keys``), counted as it is read."""
        if class_keys is None or len(class_keys) > self.MOST_CLASSES:
            raise ValueError(f"candidates are counted for {self.MOST_CLASSES} classes at most")
        self.keys = class_keys
        held = [F.count_if(F.array_contains("class_keys", key)) for key in class_keys]
        metrics = [n.alias(f"c{i}") for i, n in enumerate(held)]
        return seen.observe(self.seen, F.count(F.lit(1)).alias("rows"), *metrics)

    def compared(self, permissions: DataFrame, principals: DataFrame) -> DataFrame:
        """Per class: chunks handed to the scorer against chunks the rule allows,
        by the predicate form of the rule on permission signatures.  The search
        must have run."""
        found = self.seen.get
        given = permissions.sparkSession.createDataFrame(
            [(key, found[f"c{i}"]) for i, key in enumerate(self.keys)],
            "class_key string, scored long",
        )
        allowed = allowed_counts(permissions, principal_classes(principals))
        return allowed.join(given, "class_key", "full").select(
            "class_key",
            F.coalesce("scored", F.lit(0)).alias("scored"),
            F.coalesce("allowed", F.lit(0)).alias("allowed"),
        )


def allowed_counts(permissions: DataFrame, classes: DataFrame) -> DataFrame:
    per_signature = permissions.groupBy("required_clearance", "allowed_departments").agg(
        F.count("*").alias("n")
    )
    return (
        predicate_pairs(per_signature, classes)
        .groupBy("class_key")
        .agg(F.sum("n").alias("allowed"))
    )


def predicate_pairs(signatures: DataFrame, classes: DataFrame) -> DataFrame:
    """(signature, class that may see it) by evaluating the predicate itself.

    A class meets the signatures of each clearance up to its own; the predicate
    then decides on whole rows, so no department key of the join form is used.
    """
    levels = signatures.select(F.col("required_clearance").alias("level")).distinct()
    lowest = levels.agg(F.min("level")).first()[0]
    if lowest is None:  # without a clearance no row is visible
        lowest = 0
    who = (
        classes.select(F.struct("department", "clearance").alias("c"))
        .distinct()
        .where(F.col("c.clearance") >= lowest)
        .select("c", F.explode(F.sequence(F.lit(lowest), "c.clearance")).alias("level"))
    )
    return (
        signatures.join(who, F.col("required_clearance") == F.col("level"))
        .where(
            visible("required_clearance", "allowed_departments", "c.clearance", "c.department")
        )
        .withColumn("class_key", class_key("c.department", "c.clearance"))
        .drop("c", "level")
    )


def rule_disagreements(
    permissions: DataFrame, principals: DataFrame, sets: DataFrame | None = None
) -> DataFrame:
    """Pairs on which the predicate and the join form of the rule differ.

    ``sets`` are the class sets a search used, by default those of the join form.
    """
    classes = principal_classes(principals)
    columns = ["required_clearance", "access_keys", "class_key"]
    by_predicate = (
        predicate_pairs(
            permissions.select("required_clearance", "allowed_departments").distinct(), classes
        )
        .withColumn("access_keys", access_keys("allowed_departments"))
        .select(*columns)
        .distinct()
    )
    by_join = (class_sets(permissions, classes) if sets is None else sets).select(
        "required_clearance", "access_keys", F.explode("class_keys").alias("class_key")
    )
    only_predicate = by_predicate.join(by_join, columns, "left_anti")
    only_join = by_join.join(by_predicate, columns, "left_anti")
    return only_predicate.withColumn("side", F.lit("predicate")).unionByName(
        only_join.withColumn("side", F.lit("join"))
    )


def out_of_scope(hits: DataFrame) -> DataFrame:
    """Rows whose own principal may not see them (a null verdict is a leak)."""
    return hits.where(
        ~visible("required_clearance", "allowed_departments", "clearance", "department")
    )


def naive_losses(compared: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows each persona loses on the leaky path, over all its queries."""
    return (
        compared.join(requests.select("request_id", "persona"), "request_id")
        .groupBy("persona")
        .agg(
            F.sum("entitled_count").alias("entitled"),
            F.sum("naive_count").alias("naive"),
            F.sum("lost").alias("lost"),
        )
    )


def log_corpus_checks(
    events: DataFrame, hosts: DataFrame, principals: DataFrame, limit: int = C.DEFAULT_LOG_LIMIT
) -> DataFrame:
    """One row per corpus condition that leak audits rely on."""
    registered = hosts.select(F.col("name").alias("host"))
    orphans = (
        events.select("host")
        .distinct()
        .join(broadcast_if_small(registered), "host", "left_anti")
        .agg(F.count("*").alias("value"))
        .select(F.lit("unregistered_hosts").alias("check"), "value")
    )
    registry = hosts.select(
        F.col("name").alias("host"), "required_clearance", "allowed_departments"
    )
    per_host = events.groupBy("host").agg(F.count("*").alias("n"))
    pairs = predicate_pairs(registry, principal_classes(principals)).select("host", "class_key")
    per_class = (
        pairs.join(broadcast_if_small(per_host), "host", "left")
        .groupBy("class_key")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )
    starved = per_class.agg(F.count_if(F.col("n") < limit).alias("value")).select(
        F.lit("classes_below_limit").alias("check"), "value"
    )
    types = events.agg(F.count_distinct("event_type").alias("value")).select(
        F.lit("event_types").alias("check"), "value"
    )
    newest = (
        events.orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc())
        .limit(limit + 5)
        .join(registry, "host", "left")
        .agg(F.count_if(F.coalesce("required_clearance", F.lit(99)) > 1).alias("value"))
        .select(F.lit("newest_hidden_from_lowest").alias("check"), "value")
    )
    return orphans.unionByName(starved).unionByName(types).unionByName(newest)


def exposed_columns(df: DataFrame, banned=("text", "body", "title", "doc_title", "raw")) -> list:
    """Column names that would carry content out; must be empty for records."""
    return [name for name in df.columns if name.lower() in banned]
