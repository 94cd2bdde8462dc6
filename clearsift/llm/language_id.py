"""Language identification by rank-order profiles of n-grams."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from clearsift.llm.batches import small_batches

PROFILE = 300
FLUSH_WORDS = 200_000
_LETTERS = "[^\\W\\d_]+"
# Figures that the pattern takes for letters: numbers of categories No and Nl.
_FIGURES = "[^\\W\\d_a-z]"


def _words(text: str) -> str:
    """Lower-case letters with one underscore before and after every word."""
    import re

    lowered = text.lower()
    figures = {c for c in set(re.findall(_FIGURES, lowered)) if not c.isalpha()}
    if figures:
        lowered = lowered.translate(dict.fromkeys(map(ord, figures), " "))
    return "_" + "_".join(re.findall(_LETTERS, lowered)) + "_"


def _grams(marked: str):
    """All n-grams of a marked text as packed code points, and the number of
    the word each stands in.  N-grams do not reach over words; a lone mark is
    none."""
    codes = np.frombuffer(marked.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    mark = codes == 95
    word = np.cumsum(mark) - 1
    inner = ~mark[1:-1]
    two = (codes[:-1] << 21) | codes[1:]
    three = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    keys = np.concatenate((codes[~mark], two, three[inner]))
    return keys, np.concatenate((word[~mark], word[:-1], word[:-2][inner]))


def _weighted(words: Counter):
    """Distinct n-grams of counted words and their counts."""
    keys, word = _grams("_" + "_".join(words) + "_")
    times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights=times[word]).astype(np.int64)


def _ranked(keys, counts, size: int):
    """The ``size`` most frequent keys in order of rank, ties by key."""
    if len(keys) > size:
        least = np.partition(counts, -size)[-size]
        near = counts >= least
        keys, counts = keys[near], counts[near]
    return keys[np.lexsort((keys, -counts))[:size]]


def profiles(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE
) -> dict[str, list[int]]:
    """Each language's most frequent n-grams in order of rank.

    Counts cover all rows given.  Tasks count words first, then the n-grams of
    their distinct words, and pass on sums; rows without text or language count
    for nothing, and without rows there is no profile.
    """

    def count(frames):
        held = {}

        def out():
            for lang, words in held.items():
                if words:
                    keys, times = _weighted(words)
                    yield pd.DataFrame({"lang": lang, "gram": keys, "n": times})
            held.clear()

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                words = held.setdefault(lang, Counter())
                words.update(_words(text).split("_"))
                words.pop("", None)
                if sum(map(len, held.values())) > FLUSH_WORDS:
                    yield from out()
        yield from out()

    counted = (
        small_batches(labelled).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInPandas(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    # First within slices of the n-grams, so no task reads all of a language.
    order = [F.desc("n"), F.asc("gram")]
    sliced = Window.partitionBy("lang", F.pmod(F.hash("gram"), F.lit(32))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    best = (
        counted.withColumn("rank", F.row_number().over(sliced))
        .where(F.col("rank") <= size)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= size)
    )
    found = {}
    for row in best.orderBy("lang", "rank").collect():  # languages x size rows
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def out_of_place(ranked: np.ndarray, profile_keys, profile_ranks, size: int) -> int:
    """Sum over the document's ranked n-grams of the distance between their
    rank and the profile's; n-grams the profile lacks count ``size``."""
    at = np.minimum(np.searchsorted(profile_keys, ranked), len(profile_keys) - 1)
    hit = profile_keys[at] == ranked
    away = np.abs(profile_ranks[at] - np.arange(len(ranked)))
    return int(np.where(hit, away, size).sum())


def predict(text: str | None, tables, size: int = PROFILE) -> tuple[str, float]:
    """The nearest language and a score in 0 to 1: one minus its share of the
    greatest distance.  ``und``, 0.0 without letters or profiles."""
    marked = _words(text) if text else "__"
    if len(marked.strip("_")) == 0 or not tables:
        return "und", 0.0
    ranked = _ranked(*np.unique(_grams(marked)[0], return_counts=True), size)
    distances = [(out_of_place(ranked, k, r, size), lang) for lang, k, r in tables]
    distance, lang = min(distances)
    return lang, 1.0 - distance / (size * len(ranked))


def tables_of(found: dict[str, list[int]]):
    tables = []
    for lang in sorted(found):
        keys = np.array(found[lang], dtype=np.int64)
        order = np.argsort(keys)
        tables.append((lang, keys[order], order))
    return tables


def identify(
    docs: DataFrame,
    found: dict[str, list[int]],
    text_col: str = "text",
    lang_col: str = "lang_pred",
    score_col: str = "score",
    size: int = PROFILE,
) -> DataFrame:
    """``docs`` with the predicted language and its score (of whole texts).

    Null texts and texts without a letter are ``und`` with score 0.0; equal
    distances go to the smaller name; all other columns and repeated rows stay.
    """
    tables = tables_of(found)
    kind = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    @F.pandas_udf(kind)
    def judge(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, tables, size) for t in column], columns=["lang", "score"])

    judged = docs.withColumn("__judged", judge(F.col(text_col)))
    return judged.withColumns(
        {lang_col: F.col("__judged.lang"), score_col: F.col("__judged.score")}
    ).drop("__judged")


def held_out(id_col: Column) -> Column:
    """True for the fifth of all ids that no profile learns from."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 5 == 0
