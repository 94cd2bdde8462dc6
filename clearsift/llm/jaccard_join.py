"""Similarity of documents by shared word shingles: a grouped prefix join.

Two sets with Jaccard similarity ``t`` or more share one of the first
``n - ceil(t n) + 1`` tokens of either, in any one order of all tokens.  The
order used is by hash, with the tokens that a measurable share of all documents
has at the end.

1.  Documents with equal sets are one node.  Nodes with equal prefix and size
    are one group, so a group is found once for all its members.
2.  Nodes that share much of their prefix meet in blocks of bounded size, where
    each is compared with a few others; what is similar is linked.  This only
    saves work: large groups of near copies are connected here with few
    comparisons, and none of it is taken as proof that others are not similar.
3.  Groups that share a prefix token and are not connected yet are paired, the
    pairs filtered by size, position and the number of common prefix tokens,
    expanded to their members and verified on the whole sets.  A pair that is connected already needs no check: a
    further link between its nodes changes no component.

So every link that could join two components is verified, and no list of a
frequent token is paired with itself once its documents are connected.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from clearsift.functions.scale import cut, scratch_path
from clearsift.llm import shingles
from clearsift.llm.batches import small_batches, unused
from clearsift.llm.components import components, star_labels
from clearsift.sources import files

SIZE = 5
PERCENT = 80
# Tokens of more than 1 / FREQUENT_SHARE of all documents (and FREQUENT_LEAST
# documents) go last.  At most FREQUENT_SHARE x mean set size are that frequent.
FREQUENT_SHARE = 1000
FREQUENT_LEAST = 50
BLOCK = 256
TRIES = 16
SAMPLES = 4
BROADCAST_NODES = 2_000_000


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` of their union in common."""
    if len(one) > len(other):
        one, other = other, one
    if 100 * len(one) < percent * len(other):
        return False
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    common = int(np.count_nonzero(other[at] == one))
    return 100 * common >= percent * (len(one) + len(other) - common)


def _frequent(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Tokens that go last.  A token of a large share of all documents has that
    share in some task, so each task need only tell of its own frequent ones;
    their sums are from below, and any set of tokens gives a right order."""

    def local(batches):
        from pyarrow import RecordBatch, array

        for batch in batches:
            sets = [shingles.shingle_set(x.as_buffer(), size) if x.is_valid else () for x in batch.column(0).cast("binary")]
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(2, len(sets) // FREQUENT_SHARE)
            yield RecordBatch.from_arrays(
                [array(tokens[often]), array(counts[often])], names=["token", "n"]
            )

    least = max(FREQUENT_LEAST, docs.count() // FREQUENT_SHARE)
    counted = docs.select(text_col).mapInArrow(local, "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n")
    )
    rows = counted.where(F.col("n") > least).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64))


def shingle_sets(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    size: int = SIZE,
    percent: int = PERCENT,
    path: str | None = None,
) -> DataFrame:
    """A stored table (under ``path``) of ``row`` (a number for each row), ``id``, ``text_key``
    (digest of the text), ``n``, ``digest`` (of the set, null without words),
    ``grp`` (hash of prefix and size), ``prefix`` (the head of the set in the
    common order) and ``text`` (UTF-8).  A whole set takes more room than its
    text, so the few that are compared are made from it again."""
    spark = small_batches(docs).sparkSession
    last = spark.sparkContext.broadcast(_frequent(docs, text_col, size))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("text_key", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("grp", T.LongType()),
            T.StructField("prefix", T.ArrayType(T.LongType(), False)),
            T.StructField("text", T.BinaryType()),
        ]
    )

    def sets(batches):
        from pyarrow import RecordBatch, array
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        frequent = last.value
        row_number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [[] for _ in range(6)]
                for text in part.column(1).cast("binary"):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    tokens = shingles.shingle_set(raw, size)
                    n = len(tokens)
                    if n and len(frequent):
                        where = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                        often = frequent[where] == tokens
                        if often.any():
                            ordered = np.concatenate((tokens[~often], tokens[often]))
                        else:
                            ordered = tokens
                    else:
                        ordered = tokens
                    cut_at = n - least_overlap(n, percent) + 1 if n else 0
                    prefix = ordered[:cut_at]
                    key = shingles.digest(prefix.tobytes(), n.to_bytes(8, "little"))
                    values = (
                        hashlib.md5(raw).digest(), n, shingles.digest(tokens.tobytes()) if n else None,
                        int.from_bytes(key[:8], "little", signed=True), prefix, raw,
                    )
                    for column, value in zip(columns, values):
                        column.append(value)
                yield RecordBatch.from_arrays(
                    [
                        array(np.arange(row_number, row_number + part.num_rows)),
                        part.column(0),
                        *(array(c, f.type) for c, f in zip(columns, list(out)[2:])),
                    ],
                    schema=out,
                )
                row_number += part.num_rows

    path = path or scratch_path(spark, "shingle-sets")
    docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        sets, schema
    ).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` with a broadcast hint behind a count; they are stored."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows


def _with_texts(rows: DataFrame, sets: DataFrame, node: str, out: str) -> DataFrame:
    """``rows`` with the text of the node in column ``node``: nodes are row
    numbers of the stored sets."""
    texts = sets.select(F.col("row").alias(node), F.col("text").alias(out))
    return texts.join(_sized(rows), node)


def _links_in_blocks(placed: DataFrame, size: int, percent: int) -> DataFrame:
    """Nodes ``b`` of each block connected to ``a``, the first of their cluster.
    Every node is compared with the first and the newest member of at most TRIES
    clusters of the block, and joins the first it is similar to."""

    def link(batches):
        from pyarrow import RecordBatch, array

        block, clusters, found = None, [], []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            nodes, texts = batch.column(2).to_pylist(), batch.column(3)
            for i, key in enumerate(keys):
                if key != block:
                    block, clusters = key, []
                own = shingles.shingle_set(texts[i].as_buffer(), size)
                home = None
                for number, cluster in enumerate(clusters[:TRIES]):
                    for node, members in cluster:
                        if node != nodes[i] and similar(own, members, percent):
                            home = number
                            found.append((cluster[0][0], nodes[i]))
                            break
                    if home is not None:
                        break
                me = (nodes[i], own)
                if home is None:
                    clusters.insert(0, [me])
                else:
                    cluster = clusters.pop(home)
                    clusters.insert(0, [cluster[0], me])
                del clusters[TRIES:]
            if found:
                yield RecordBatch.from_arrays(
                    [array([f[0] for f in found], "int64"), array([f[1] for f in found], "int64")],
                    names=["a", "b"],
                )
                found = []

    ordered = placed.repartition("key", "part").sortWithinPartitions(
        "key", "part", "own", "node"
    )
    return ordered.select("key", "part", "node", "text").mapInArrow(link, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` (stored) whose whole sets are similar."""

    def check(batches):
        from pyarrow import array

        last, own = None, None  # pairs of one ``a`` mostly follow each other
        for batch in batches:
            nodes, one, other = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            yes = []
            for i, node in enumerate(nodes):
                if node != last:
                    last, own = node, shingles.shingle_set(one[i].as_buffer(), size)
                yes.append(similar(own, shingles.shingle_set(other[i].as_buffer(), size), percent))
            yield batch.select([0, 1]).filter(array(yes, "bool"))

    # The text of ``b`` travels once for each pair, that of ``a`` once.
    first = _with_texts(cut(pairs.select("a").distinct()), sets, "a", "one")
    second = _with_texts(pairs, sets, "b", "other").select("a", "b", "other")
    return (
        second.join(first, "a")
        .select("a", "b", "one", "other")
        .mapInArrow(check, "a long, b long")
    )


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links as pairs of different labels, each once; nodes without a label are
    their own."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("a_label"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("b_label"))
    found = links.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    a, b = F.coalesce("a_label", "a"), F.coalesce("b_label", "b")
    return (
        found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    )


def _in_blocks(placed: DataFrame) -> DataFrame:
    """``key``, ``node``, ``own`` with a number ``part``, so that no block grows
    with its key.  The nodes of a key with the fewest tokens of their own, likely
    the originals of its near copies, are in all its blocks."""
    many = placed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    rows = placed.join(many, "key")
    part = F.pmod(F.xxhash64("node", "key"), F.col("parts"))
    first = Window.partitionBy("key").orderBy("own", "node")
    hubs = (
        rows.where("parts > 1")
        .withColumn("at", F.row_number().over(first))
        .where(F.col("at") <= SAMPLES)
    )
    columns = ["key", "node", "own"]
    return (
        rows.select(*columns, part.alias("part"))
        .union(hubs.select(*columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        .distinct()
    )


def nodes_of(sets: DataFrame) -> DataFrame:
    """``digest``, ``node`` (its first row), ``least`` (its smallest id)."""
    return cut(
        sets.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("row").alias("node"), F.min("id").alias("least"))
    )


def link_components(
    sets: DataFrame, nodes: DataFrame, size: int = SIZE, percent: int = PERCENT
) -> DataFrame:
    """``node``, ``component`` (smallest node) of all nodes with a link."""
    own = nodes.select("node")
    rows = sets.join(_sized(own), F.col("row") == F.col("node"))
    prefix = rows.select("node", F.posexplode("prefix").alias("pos", "token"))
    counts = cut(prefix.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"))
    # ``before``: shared tokens of the node ahead of this one.
    ahead = Window.partitionBy("node").orderBy("pos")
    shared = cut(
        prefix.join(_sized(counts), "token").withColumn("before", F.row_number().over(ahead) - 1)
    )
    sizes = rows.select("node", "grp", "n")
    in_prefix = lambda n: n - F.ceil(n * percent / 100) + 1

    # First round: by the most shared token of each node, and by its group.  A
    # pair needs no block, so keys of two nodes are left to the last step.
    popular = F.slice(
        F.sort_array(F.collect_list(F.struct("times", "token")), asc=False), 1, 3
    )
    busy = cut(
        shared.where(F.col("times") >= 4)
        .groupBy("node")
        .agg(popular.alias("best"), F.count("*").alias("shares"))
        .join(sizes, "node")
        .where(F.col("shares") * 3 >= in_prefix(F.col("n")))
        .select("node", "best", (in_prefix(F.col("n")) - F.col("shares")).alias("own"))
    )
    groups = sizes.groupBy("grp").agg(F.count("*").alias("times")).where("times > 3")
    by_group = sizes.join(groups, "grp").select(
        "node", F.col("grp").alias("key"), F.lit(0).cast("long").alias("own")
    )
    by_token = busy.select("node", F.col("best")[0]["token"].alias("key"), "own")
    placed = cut(_in_blocks(by_token.union(by_group)))
    links = cut(_links_in_blocks(_with_texts(placed, sets, "node", "text"), size, percent).distinct())
    joined = cut(star_labels(links))

    def labelled(rows):
        return rows.join(joined, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )

    # Second round: a few nodes of each component by three tokens.
    few = Window.partitionBy("key", "component").orderBy("own", "node")
    some = (
        labelled(busy.select("node", F.explode("best.token").alias("key"), "own"))
        .withColumn("at", F.row_number().over(few))
        .where(F.col("at") <= SAMPLES)
    )
    mixed = some.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    )
    some = some.join(mixed.where("least <> most"), "key").select("node", "key", "own")
    placed = cut(_in_blocks(some))
    more = _links_in_blocks(_with_texts(placed, sets, "node", "text"), size, percent)
    links = cut(links.union(more).distinct())
    between = cut(_between(links, joined))
    merged = star_labels(between).select(
        F.col("node").alias("component"), F.col("component").alias("into")
    )
    joined = cut(
        joined.union(between.selectExpr("a AS node", "a").union(between.selectExpr("b", "b")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
        .join(merged, "component", "left")
        .select("node", F.coalesce("into", "component").alias("component"))
    )

    # All groups that share a token and hold nodes of different components.
    mixed = (
        labelled(shared.select("token", "node"))
        .groupBy("token")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least <> most")
        .select("token")
    )
    lists = cut(
        labelled(shared.join(mixed, "token").join(sizes, "node"))
        .select("token", "grp", "n", "pos", "before", "component")
        .distinct()
    )
    names = ("grp", "n", "pos", "before", "component")
    one = lists.select("token", *[F.col(c).alias(f"a_{c}") for c in names])
    two = lists.select("token", *[F.col(c).alias(f"b_{c}") for c in names])
    a_n, b_n = F.col("a_n"), F.col("b_n")
    # Common tokens before this one, itself, and all behind it, at the most;
    # tokens that no other prefix has are not common, if both prefixes hold them.
    most = F.least("a_before", "b_before") + F.least(a_n - F.col("a_pos"), b_n - F.col("b_pos"))
    in_order = (a_n < b_n) | ((a_n == b_n) & (F.col("a_grp") < F.col("b_grp")))
    same = (a_n == b_n) & (F.col("a_grp") == F.col("b_grp"))
    same &= F.col("a_component") < F.col("b_component")
    # Of the common tokens, those up to where one prefix ends are in both; the
    # others are behind that prefix.
    behind = F.greatest(a_n - in_prefix(a_n), b_n - in_prefix(b_n))
    pairs = (
        one.join(
            two,
            (one["token"] == two["token"])
            & (in_order | same)
            & (F.col("a_component") != F.col("b_component"))
            & (100 * a_n >= percent * b_n)
            & ((100 + percent) * most >= percent * (a_n + b_n)),
        )
        .groupBy("a_grp", "a_component", "a_n", "b_grp", "b_component", "b_n")
        .agg(F.count("*").alias("common"))
        .where((100 + percent) * (F.col("common") + behind) >= percent * (a_n + b_n))
    )
    members = labelled(sizes.select("node", "grp"))
    left = members.select(*[F.col(c).alias(f"a_{c}") for c in ("node", "grp", "component")])
    right = members.select(*[F.col(c).alias(f"b_{c}") for c in ("node", "grp", "component")])
    expanded = cut(
        pairs.join(left, ["a_grp", "a_component"])
        .join(right, ["b_grp", "b_component"])
        .select(
            F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")
        )
        .distinct()
    )
    # Labels so far are parts of components; what links parts joins them.
    parts = cut(_between(links.union(_verified(expanded, sets, size, percent)), joined))
    whole = components(parts).select(
        F.col("node").alias("component"), F.col("component").alias("whole")
    )
    nodes = joined.union(parts.selectExpr("a", "a")).union(parts.selectExpr("b", "b"))
    return (
        nodes.groupBy("node")
        .agg(F.min("component").alias("component"))
        .join(whole, "component", "left")
        .select("node", F.coalesce("whole", "component").alias("component"))
    )


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
    path: str | None = None,
) -> DataFrame:
    """One row per document: ``id``, ``text_key``, ``n_shingles``, ``node`` and
    ``component_id``, the smallest id reachable by links, its own included.

    A null text and a text without words have an empty set, no node and no
    links; rows of equal sets are linked; null ids take part, but are never a
    component's id unless it has no other; an empty table stays empty; other
    columns are left out.  The sets are stored under ``path`` and read by the result.
    """
    sets = shingle_sets(docs, id_col, text_col, size, percent, path)
    nodes = nodes_of(sets)
    joined = link_components(sets, nodes, size, percent)
    named = cut(
        nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("digest", "node", "component", "component_id")
    rows = sets.select("id", "text_key", F.col("n").alias("n_shingles"), "digest")
    empty = F.col("digest").isNull()
    return rows.join(ids, "digest", "left").select(
        "id", "text_key", "n_shingles", "node", "component",
        F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, and
    of rows with equal id that with the smallest digest.  Rows without words
    stay; null ids come first; all columns are kept."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shingle-sets")
    found = similar_documents(docs, id_col, text_col, path=path, **options)
    found = cut(found.where("node IS NOT NULL"))
    files.remove(spark, path)  # as large as the texts
    best = found.groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("best"))
    marked = found.groupBy("component", "id", "text_key").agg(F.count("*").alias("times"))
    marked = cut(
        marked.join(best, "component").withColumn(
            "stays",
            F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key")),
        )
    )
    own, owner, key = unused(docs, "own", "id", "key")
    gone = marked.where(~F.col("stays")).select(F.col("id").alias(owner), F.col("text_key").alias(key))
    if gone.count() <= BROADCAST_NODES:
        gone = F.broadcast(gone)
    keyed = docs.withColumn(own, digest_column(F.coalesce(F.col(text_col), F.lit(""))))
    kept = keyed.join(
        gone, F.col(id_col).eqNullSafe(F.col(owner)) & (F.col(own) == F.col(key)), "left_anti"
    )
    if not marked.where("stays AND times > 1").isEmpty():  # repeated rows
        empty = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
        kept = kept.where(empty).union(kept.where(~empty).dropDuplicates([id_col, own]))
    return kept.drop(own)


def digest_column(text):
    return F.unhex(F.md5(text))
