"""Quality rules of single documents, and lines that many documents share.

Everything is columns over whole texts; only hashes of lines are shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsift.functions.scale import cut, with_fields

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
# A line is frequent on a host when more than LINE_DOCUMENTS different texts
# and more than LINE_PERCENT of that host's texts have it.  A document is
# depleted when less than LEFT_PERCENT of its words are in other lines.
LINE_DOCUMENTS = 10
LINE_PERCENT = 2
LEFT_PERCENT = 20
BROADCAST_LINES = 1_000_000


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def windows_of(words: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, in order."""
    last = F.size(words) - (size - 1)
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, size))),
    ).otherwise(F.array().cast("array<bigint>"))


def normalised_lines(text: Column) -> Column:
    """Lines with a word: lower case, white space runs as one blank."""
    lines = F.transform(
        F.split(text, "\n"), lambda x: F.lower(F.btrim(F.regexp_replace(x, BLANK, " ")))
    )
    return F.array_remove(lines, "")


def line_hashes(text: Column) -> Column:
    return F.transform(normalised_lines(text), lambda x: F.xxhash64(x))


def frequent_lines(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    line_documents: int = LINE_DOCUMENTS,
    line_percent: float = LINE_PERCENT,
) -> DataFrame:
    """``host``, ``frequent``: each host's frequent lines, as an array of hashes.

    Documents are counted by their text, so copies count once.  Below
    ``line_percent`` percent no host has more than 100 / ``line_percent`` times
    its mean number of lines, whatever its size.  The null line of every text
    counts the texts themselves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(host_col).alias("host"),
        F.unhex(F.md5(text)).alias("text"),
        F.explode(
            F.concat(
                F.array(F.lit(None).cast("bigint")), F.array_distinct(line_hashes(text))
            )
        ).alias("line"),
    )
    counts = cut(
        lines.distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("line").isNull() | (F.col("n") > line_documents))
    )
    texts = counts.where("line IS NULL").select(F.col("host").alias("of"), F.col("n").alias("texts"))
    return (
        counts.where("line IS NOT NULL")
        .join(texts, F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("n") * 100 > F.col("texts") * line_percent)
        .groupBy("host")
        .agg(F.collect_set("line").alias("frequent"))
    )


def judge(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = MIN_WORDS,
    repeat_percent: int = REPEAT_PERCENT,
    line_documents: int = LINE_DOCUMENTS,
    line_percent: float = LINE_PERCENT,
    left_percent: float = LEFT_PERCENT,
) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_frequent_words``, ``kept`` and
    ``clean_text`` (without frequent lines; null stays null).

    A null text has no words and fails the base rules; null hosts are one host;
    repeated rows get equal results; an empty table stays empty; columns of
    those names are replaced, all others kept.
    """
    lines = cut(frequent_lines(docs, text_col, host_col, line_documents, line_percent))
    held, hashes = lines.agg(F.count("*"), F.sum(F.size("frequent"))).first()
    if held + (hashes or 0) <= BROADCAST_LINES:
        lines = F.broadcast(lines)
    names = docs.columns
    made = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_frequent_words "
        "kept clean_text"
    ).split()
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names if n not in made]).alias("__row"),
        F.col(text_col).alias("__text"),
        F.col(host_col).alias("__host"),
    )
    rows = rows.join(
        lines.withColumnRenamed("host", "__of"), F.col("__host").eqNullSafe(F.col("__of")), "left"
    ).drop("__of", "__host")
    text = F.coalesce("__text", F.lit(""))
    none = F.array().cast("array<bigint>")
    rows = with_fields(
        rows,
        words_of(text).alias("__words"),
        F.split(text, "\n").alias("__lines"),
        F.coalesce("frequent", none).alias("__frequent"),
    ).drop("frequent")
    rows = with_fields(rows, windows_of(F.col("__words"), WINDOW).alias("__windows"))
    # Only texts with a hash found twice are looked at closely: windows in the
    # order of their hashes, and those equal to a neighbour in that order.
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = with_fields(
        rows,
        F.when(
            twice,
            F.array_sort(
                F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ).alias("__sorted"),
    )

    def same(one, other):
        cut_out = lambda x: F.slice("__words", x["i"] + 1, WINDOW)
        return F.coalesce((one["h"] == other["h"]) & (cut_out(one) == cut_out(other)), F.lit(False))

    repeated = F.array_sort(
        F.transform(
            F.filter(
                "__sorted",
                lambda x, i: same(x, F.get("__sorted", i - 1)) | same(x, F.get("__sorted", i + 1)),
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct(
            (s["n"] + p + WINDOW - F.greatest(s["end"], p)).alias("n"), (p + WINDOW).alias("end")
        ),
    )["n"]
    worded = F.filter("__lines", lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    frequent_hash = lambda x: F.xxhash64(F.lower(F.btrim(F.regexp_replace(x, BLANK, " "))))
    any_frequent = F.size("__frequent") > 0
    rare = F.filter("__lines", lambda x: ~F.array_contains("__frequent", frequent_hash(x)))
    rows = with_fields(
        rows,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        worded.alias("__worded"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(any_frequent, rare).otherwise(F.col("__lines")).alias("__rare"),
    )
    rows = with_fields(rows, F.array_join("__rare", "\n").alias("__clean"))
    left = F.when(any_frequent, F.size(words_of(F.col("__clean")))).otherwise(F.size("__words"))
    rows = with_fields(
        rows,
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long").alias("n_dup_lines"),
        ((F.col("n_words") < min_words)
         | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))).alias("base_failed"),
        (F.col("n_words") - left).alias("n_frequent_words"),
        F.when(F.col("__text").isNotNull(), F.col("__clean")).alias("clean_text"),
    )
    left = F.col("n_words") - F.col("n_frequent_words")
    return rows.withColumn(
        "kept", ~F.col("base_failed") & (100 * left >= left_percent * F.col("n_words"))
    ).select("__row.*", *made)
