"""Removal of benchmark passages by windows of words."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsift.functions.scale import cut, with_fields
from clearsift.llm.batches import unused

NGRAM = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Pieces of a text in its own spelling: words, and what stands between them.
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 2_000_000


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; other letters stay as they are."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BREAK), "")


def windows_of(words: Column, size: int) -> Column:
    """``(pos, len, hash)`` of all windows of ``size`` words; pos from 1."""
    last = F.size(words) - (size - 1)
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.struct(
                i.alias("pos"), F.lit(size).alias("len"), F.xxhash64(F.slice(words, i, size)).alias("hash")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<pos:int,len:int,hash:bigint>>"))


def benchmark_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = NGRAM
) -> DataFrame:
    """``hash``, ``window``, ``len``, ``items``: each distinct window once, with
    the ids of the items that have it.  An item shorter than a window, but not
    without words, is one window.  Rows with equal id are one item; a null id
    is the empty id."""
    items = with_fields(
        benchmark.select(
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
            F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
        ),
        words_of(F.col("__text")).alias("words"),
    )
    n = F.size("words")
    short = F.array(F.struct(F.lit(1).alias("pos"), n.alias("len"), F.xxhash64("words").alias("hash")))
    spans = F.when((n > 0) & (n < size), short).otherwise(windows_of(F.col("words"), size))
    return (
        items.select("item", "words", F.inline(spans))
        .select(
            "hash", "len", "item",
            F.array_join(F.slice("words", F.col("pos"), F.col("len")), " ").alias("window"),
        )
        .groupBy("hash", "len", "window")
        .agg(F.collect_set("item").alias("items"))
    )


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = NGRAM,
) -> DataFrame:
    """One row per document: the columns ``keep``, ``n_words``, ``spans``
    (merged ``start``, ``end`` of hit words, from 0), ``n_hit`` and ``items``.

    Windows of whole texts meet the benchmark's in one pass; a hash found is
    verified by its words.  Only rows with a hit and one row per document are
    shuffled.  The benchmark's windows are broadcast up to BROADCAST_WINDOWS,
    else joined by their hash.  A null or empty text has no words; repeated
    rows are scanned each; without items or documents nothing is hit.
    """
    known = cut(benchmark_windows(benchmark, item_col, item_text_col, size))
    lengths = [r[0] for r in known.select("len").distinct().collect()]  # at most `size`
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    rows = docs.select(
        F.struct(*keep).alias("__keep"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
        F.monotonically_increasing_id().alias("__id"),
    )
    rows = with_fields(rows, words_of(F.col("__text")).alias("__words")).drop("__text")
    # The null window of every document carries it through the join.
    none = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("hash")
    )
    spans = F.concat(F.array(none), *[windows_of(F.col("__words"), n) for n in sorted(lengths)])
    met = (
        rows.select("__id", "__keep", "__words", F.inline(spans))
        .join(known.withColumnRenamed("len", "of_len"), "hash", "left")
        .where(
            "pos = 0 OR (len = of_len AND window = array_join(slice(__words, pos, len), ' '))"
        )
    )
    hit = F.col("pos") > 0
    found = met.groupBy("__id").agg(
        F.first(F.when(~hit, F.col("__keep")), ignorenulls=True).alias("__keep"),
        F.max(F.when(~hit, F.size("__words"))).cast("long").alias("n_words"),
        F.array_sort(
            F.collect_set(F.when(hit, F.struct(F.col("pos").alias("start"), "len")))
        ).alias("__hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # The longest hit of each start; then no hit reaches further back than
    # `size` others, so spans begin and end by looking at those only.
    longest = F.filter(
        "__hits",
        lambda x, i: F.coalesce(F.get("__hits", i + 1)["start"] != x["start"], F.lit(True)),
    )
    found = with_fields(found, longest.alias("__longest")).drop("__hits")
    stop = lambda x: x["start"] + x["len"]

    def before(i):
        """Hits ahead of index ``i`` that may reach it."""
        return F.slice("__longest", F.greatest(i - size, F.lit(0)) + 1, F.least(i, F.lit(size)))

    begins = F.transform(
        "__longest", lambda x, i: ~F.exists(before(i), lambda y: stop(y) >= x["start"])
    )
    found = with_fields(found, begins.alias("__begins"))
    first = F.filter("__longest", lambda x, i: F.get("__begins", i))
    last = F.filter(
        F.transform(
            "__longest",
            lambda x, i: F.when(
                F.coalesce(F.get("__begins", i + 1), F.lit(True)),
                F.array_max(F.transform(before(i + 1), stop)),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    spans = F.zip_with(
        first,
        last,
        lambda x, end: F.struct((x["start"] - 1).alias("start"), (end - 1).alias("end")),
    )
    found = with_fields(found, spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select("__keep.*", "n_words", "spans", n_hit.cast("long").alias("n_hit"), "items")


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **names
) -> DataFrame:
    """``docs`` without benchmark passages: contaminated documents are removed,
    or (``remove="spans"``) their hit words with the break behind each.

    Contamination is a matter of the text, so documents meet the scan's finds by
    a digest of it.  Null texts are clean; all columns are kept.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    own, owner, held, parts = unused(docs, "digest", "found", "spans", "pieces")
    found = scan(docs, benchmark, [digest.alias("found")], text_col, **names)
    found = cut(
        found.where("n_hit > 0")
        .groupBy(F.col("found").alias(owner))
        .agg(F.first("spans").alias(held))
    )
    keyed = docs.withColumn(own, digest)
    if remove == "documents":
        return keyed.join(found, F.col(own) == F.col(owner), "left_anti").drop(own)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(PIECES), 0)
    joined = keyed.join(found, F.col(own) == F.col(owner), "left")
    joined = with_fields(joined, F.when(F.col(held).isNotNull(), pieces).alias(parts))
    head = F.when(F.get(parts, F.lit(0)).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    kept = F.filter(
        parts,
        lambda p, i: (i < head)
        | ~F.exists(
            held,
            lambda s: (s["start"] <= F.floor((i - head) / 2)) & (F.floor((i - head) / 2) < s["end"]),
        ),
    )
    new = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return joined.withColumn(text_col, new).select(*docs.columns)
