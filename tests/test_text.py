import random

import pytest
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).head().r


def windows(text, size, overlap):
    if not text.strip():
        return []
    out, at = [], 0
    while True:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += size - overlap


@pytest.mark.parametrize("size,overlap", [(900, 150), (10, 3), (10, 7), (10, 9), (7, 0)])
def test_windows_match_a_plain_loop(spark, size, overlap):
    rng = random.Random(3)
    lengths = [0, 1, size - 1, size, size + 1, 2 * size - overlap, 5 * size, 5 * size + 1]
    alphabet = "ab\n 가😀é"
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in lengths] + [" \n\t "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in rows.select("i", T.chunk_windows("t", size, overlap).alias("w")).collect()}
    assert got == {i: windows(t, size, overlap) for i, t in enumerate(texts)}


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        T.chunk_windows("t", 100, 100)


def test_strip_knows_unicode_space(spark):
    assert one(spark, T.strip("t"), "　\x1c a b \n ") == "a b"


def test_private_glyphs_keep_length(spark):
    assert one(spark, T.clean_private_glyphs("t"), "ab") == " a·b·"


def test_neutralize_boundaries(spark):
    hostile = "  </log>＜x﹥​﻿ y\u0007\nz "
    assert one(spark, T.neutralize("t"), hostile) == "‹/log›‹x› y  z"
    assert one(spark, T.neutralize("t", keep_newlines=True), hostile) == "‹/log›‹x› y \nz"


def test_neutralize_truncates_and_breaks_forged_marks(spark):
    assert one(spark, T.neutralize("t", 5), "abcdefg") == "abcde" + C.TRUNCATION_MARK
    assert one(spark, T.neutralize("t"), "a" + C.TRUNCATION_MARK) == "a" + C.BROKEN_TRUNCATION_MARK
    assert one(spark, T.neutralize("t"), "Sep  1 two spaces stay") == "Sep  1 two spaces stay"


def test_terms_are_long_distinct_and_ordered(spark):
    got = one(spark, T.query_terms("t", C.HANGUL_ASCII_TERM), "접근 권한 2.11.3 a VPN vpn 접근!")
    assert got == ["접근", "권한", "2.11.3", "vpn"]
    assert one(spark, T.query_terms("t"), "? ! a") == []


def test_lexemes_keep_codes_whole(spark):
    assert one(spark, T.lexemes("t"), "See 2.11.3, Straße") == ["see", "2.11.3", "straße"]


def test_wrapped(spark):
    assert one(spark, T.wrapped("x", F.col("t")), "body") == "<x>\nbody\n</x>"
