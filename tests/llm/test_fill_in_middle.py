"""Fill-in-the-middle texts: skip list, forms and exact round trips."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clearsift.llm import fill_in_middle as fim

TEXTS = [
    "one\ntwo\nthree\n", "", None, "\n", "\n\n\n", "no line end", "é ß\n漢字 𝄞\n\r\n  x\x0b\x85y\n tail",
    "has <P> inside\nx", "has <S>\n", "<M>", "<P\n>\n<\nS>", "a\n" * 3000, "x" * 100_000 + "\n" + "y\n" * 50, " \n \n",
]


def plain(key, text, rate=100, spm_rate=50, seed=7):
    """The rule in plain Python, with string slices."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h1, h2, h3, h4 = fim.draws_of(key, seed)
    n = len(lines)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return (n, "plain", None, None, text)
    prefix, middle, suffix = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if h4 % 100 < spm_rate:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_skip_list_finds_every_rank():
    random.seed(1)
    for many in [0, 1, 2, 3, 4, 5, 6, 17, 64, 65, 300, 5000]:
        lengths = [random.choice([0, 1, 1, 7, 80]) for _ in range(many)]
        found = fim.SkipList(lengths)
        ranks = range(many + 1) if many < 400 else random.sample(range(many + 1), 200)
        assert [found.code_points_before(r) for r in ranks] == [sum(lengths[:r]) for r in ranks]
    assert len(fim.SkipList([1] * 50_000).lanes) > 5
    assert sum(len(x[0]) for x in fim.SkipList([1] * 50_000).lanes) < 80_000


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm_rate": 80, "seed": 3}])
def test_every_form_and_the_way_back(spark, options):
    rows = [(i, t, "clash", 0) for i, t in enumerate(TEXTS * 12)] + [(None, "a\nb\nc", "clash", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, `fim_form` string, `__cuts` int")
    done = fim.transform(docs.repartition(3), **options)
    assert done.columns[:3] == ["doc_id", "text", "__cuts"]
    back = done.withColumn("back", fim.restore(F.col("fim_output"), F.col("fim_form")))
    found = back.select("doc_id", "text", "fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output", "back").collect()
    assert len(found) == len(rows)
    for key, text, *got, restored in found:
        assert tuple(got) == plain(key, text, **options)
        assert restored == (text or "")
    if not options:
        assert {r[3] for r in found} == {"plain", "psm", "spm"}
    assert fim.transform(docs.where("false")).count() == 0


def test_draws_agree(spark):
    rows = spark.createDataFrame([(0,), (123456789012,), (None,)], "k long")
    for key, *drawn in rows.select("k", *fim.draws("k", 7)).collect():
        assert drawn == fim.draws_of(key)
