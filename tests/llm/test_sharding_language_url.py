"""Shards, languages and the URL filter."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from clearsift.llm import language_id, sharding, url_filter
from clearsift.llm import queries  # noqa: F401  (importing registers)
from clearsift.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_slots_are_gapless_and_growth_moves_into_the_new_shard_only(spark):
    rows = [(i, f"text {i}", "x") for i in range(3000)] + [(None, None, "x"), (None, "é", "x"), (7, "text 7", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = sharding.shard(docs, shards=16).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in got)
    assert 0.6 * 3000 / 17 < moved < 1.4 * 3000 / 17
    null = [r for r in got if r.doc_id is None]
    assert len({r.shard for r in null}) == 1
    assert {(r.size, r.text_crc32) for r in null} == {(1, 0), (3, zlib.crc32("é".encode()))}
    assert sharding.shard(docs.where("false")).count() == 0


def test_weights_set_the_shares(spark):
    keys = spark.range(20_000)
    shares = dict(
        keys.select(sharding.shard_of(F.col("id"), [1, 2, 0, 5]).alias("s")).groupBy("s").count().collect()
    )
    assert set(shares) == {0, 1, 3}
    for shard, weight in ((0, 1), (1, 2), (3, 5)):
        assert abs(shares[shard] / 20_000 - weight / 8) < 0.02
    both = keys.select(
        sharding.shard_of(F.col("id"), [1, 1, 1]).alias("a"),
        sharding.shard_of(F.col("id"), [1, 1, 2]).alias("b"),
    )
    assert both.where("a <> b AND b <> 2").count() == 0


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op5_rank_order_language"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    both = rows.join(docs, "doc_id").collect()
    held = [r for r in both if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in both)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in both)


def test_profiles_equal_plain_counts(spark):
    texts = [("en", "The cat, the hat!"), ("en", "THE END"), ("xx", "za za ze"), (None, "no"), ("en", None)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    found = language_id.profiles(docs, size=6)

    def plain(words, size):
        counts = {}
        for w in words:
            marked = [ord(c) for c in f"_{w}_"]
            grams = [(c,) for c in marked[1:-1]]
            grams += [tuple(marked[i : i + n]) for n in (2, 3) for i in range(len(marked) - n + 1)]
            for g in grams:
                key = 0
                for c in g:
                    key = key << 21 | c
                counts[key] = counts.get(key, 0) + 1
        return sorted(counts, key=lambda k: (-counts[k], k))[:size]

    assert found == {"en": plain("the cat the hat the end".split(), 6), "xx": plain("za za ze".split(), 6)}


def test_distance_and_undecided_texts(spark):
    keys, ranks = np.array([3, 5, 9]), np.array([2, 0, 1])
    assert language_id.out_of_place(np.array([5, 4, 3]), keys, ranks, 300) == 0 + 300 + 0
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "a"), (3, "12 !!", "a"), (4, "cat", "a"), (4, "cat", "a"), (5, "cat " * 50_000, "a")],
        "doc_id long, text string, lang_pred string",
    )
    found = language_id.profiles(spark.createDataFrame([("en", "cat hat")], "lang string, text string"))
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.identify(docs, found).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en")]
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), found).count() == 0


def labelled(spark, n, start=0):
    rows = []
    for i in range(start, start + n):
        bad = i * 7919 % 10 < 4
        host = f"win-{i * 31 % 97}-{i}.example.biz" if bad else f"news.site{i % 9}.org"
        rest = f"/p{i * 77 % 99991}?a={i}&b={i * 3}&c={i}" if bad else "/a/story/of-things"
        rows.append((f"https://{host}{rest}", 1.0 if bad else 0.0, "x"))
    return spark.createDataFrame(rows, "url string, block double, host string")


def test_trees_learn_from_labelled_urls(spark):
    model = url_filter.train(labelled(spark, 600), trees=5, depth=3)
    judged = url_filter.judge(labelled(spark, 400, 5000), model, rules=())
    right = judged.where("(verdict = 'block') = (block = 1.0)").count()
    assert right >= 0.95 * 400


def test_suffixes_count_all_rows_and_repeats_do_not_fill_the_sample(spark):
    rows = labelled(spark, 300).select("url", "block")
    least = rows.where("block = 1").selectExpr("min_by(url, xxhash64(url))").first()[0]
    repeated = spark.createDataFrame([(least, 1.0)] * 400, "url string, block double")
    model = url_filter.train(rows.union(repeated), trees=2, depth=2, max_rows=100)
    seen = {r["__suffix"]: (r.suffix_rate, r.suffix_seen) for r in model.suffixes.collect()}
    rate = 520 / 700
    assert math.isclose(model.rate, rate) and model.model is not None
    assert math.isclose(seen["biz"][0], (520 + 10 * rate) / 530)
    assert math.isclose(seen["biz"][1], math.log1p(520)) and math.isclose(seen["org"][1], math.log1p(180))


def test_rules_hosts_and_paths(spark):
    one = spark.createDataFrame([("http://a.org", 0.0)], "url string, block double")
    model = url_filter.train(one)  # labels of one kind only
    cases = {
        "http://x.example.com/en/1?q": ("x.example.com", "/en/1", "example.com/en/", "block"),
        "http://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://m.www.example.com/en/a#b": ("m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://example.com/de/": ("example.com", "/de/", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://com?x=/": ("com", "", None, "allow"),
        "ftp://a.net/es/x": ("a.net", "/es/x", "net/es/", "block"),
        "a://b://c.net/fr/": ("b:", "//c.net/fr/", None, "allow"),
        "x\n://net/fr/\ny?z": ("net", "/fr/\ny", "net/fr/", "block"),
        "no scheme.net/es/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    urls = spark.createDataFrame([(u, 1) for u in [*cases, None]], "url string, path int")
    got = [(r.url, (r.host, r.path, r.rule, r.verdict)) for r in url_filter.judge(urls, model).collect()]
    assert len(got) == len(cases) + 1 and all(cases[u] == v for u, v in got)
    assert url_filter.judge(urls.where("false"), url_filter.train(one.where("false"))).count() == 0


def test_entropy_and_counts(spark):
    url = "https://a-b.c.net/x/yy?k=1&l=22"
    row = url_filter.lexical(spark.createDataFrame([(url,)], "url string"), "url").first()
    shares = [url.count(c) / len(url) for c in set(url)]
    assert math.isclose(row.entropy, -sum(p * math.log2(p) for p in shares))
    assert (row.depth, row.labels, row.parameters, row.hyphens, row.secure) == (2, 3, 2, 1, 1)
    assert math.isclose(row.digit_ratio, 3 / len(url))


def test_figures_are_no_letters():
    tables = language_id.tables_of({"xx": [ord("a")]})
    for text in ("²", "½ ① Ⅷ", "12 _ ³", "\u0660"):
        assert language_id.predict(text, tables) == ("und", 0.0)
    assert language_id.predict("a²a", tables)[0] == "xx" and language_id._words("Aé² ªb") == "_aé_ªb_"
