"""N-gram join, passages and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest

from clearsift.functions.scale import shared_dir
from clearsift.llm import components as components_module
from clearsift.llm import jaccard_join, passage_dedup, shingles
from clearsift.llm.components import components, star_labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, component string"


def frame(spark, rows, partitions=5):
    full = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute(rows, percent=80):
    """Set sizes and components by comparing what shares any shingle."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            index[k].append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for k in s for j in index[k]).items():
            if j > i and 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)].append(key)
    out = [(key, len(sets[i]), min(least[find(i)], default=None)) for i, (key, _) in enumerate(rows)]
    return sorted(out, key=repr)


def vocabulary(rng, n):
    return " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(11)
    texts = [vocabulary(rng, rng.choice([3, 7, 40, 120])) for _ in range(150)]
    base = vocabulary(rng, 200)
    texts += [edited(rng, base, rng.randrange(1, 9)) for _ in range(300)]  # a chain of near copies
    texts += [base] * 120
    boiler = vocabulary(rng, 60)
    texts += [f"{boiler} {vocabulary(rng, rng.choice([6, 14, 15, 16, 200]))}" for _ in range(200)]
    for _ in range(25):
        one = vocabulary(rng, 90)
        texts += [one, edited(rng, one, 2), edited(rng, one, 3)]
    texts += ["Few words", "few WORDS", "few\twords\x0b", "word", "", " \n", None, vocabulary(rng, 40_000)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(None, base), (None, "alone without id"), (3, texts[3]), (3, texts[3])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_components_match_brute_force(spark, rows):
    found = jaccard_join.similar_documents(frame(spark, rows))
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in found.collect()), key=repr)
    assert got == brute(rows)


def test_no_block_hides_a_link(spark, rows, monkeypatch):
    """Blocks of two rows link next to nothing: the pairs must find it all."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", 0)
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 20)
    few = [r for r in rows if r[0] is None or r[0] % 3 == 0]
    found = jaccard_join.similar_documents(frame(spark, few))
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in found.collect()), key=repr)
    assert got == brute(few)


def test_one_of_each_component_stays(spark, rows):
    docs = frame(spark, rows)
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    kept = sorted((r.doc_id for r in left.collect() if words(r.text)), key=str)
    assert kept.count(None) == 2  # of the base and its copies the null id comes first
    components = {c for i, n, c in brute(rows) if n}
    assert len(kept) == len(components)
    assert left.where("text IS NULL OR trim(BOTH ' \n' FROM text) = ''").count() == 3
    assert jaccard_join.one_of_each(docs.where("false")).count() == 0


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = (vocabulary(random.Random(1), 500) + " ÄÖ x\u00a0y\n" + "long" * 50).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "SEGMENT", 37)
    assert (shingles.word_hashes(text) == whole).all()
    assert len(set(whole.tolist())) == len(set(words(text.decode())))


def passage_corpus():
    rng = random.Random(5)
    passage, fuzzy = vocabulary(rng, 55), vocabulary(rng, 120)
    texts = [f"{vocabulary(rng, rng.randrange(300))} {passage} {vocabulary(rng, rng.randrange(300))}" for _ in range(60)]
    texts += [f"{vocabulary(rng, 80)} {edited(rng, fuzzy, 5)} {vocabulary(rng, 80)}" for _ in range(10)]
    clean = [vocabulary(rng, rng.randrange(400)) for _ in range(40)]
    clean += [f"{vocabulary(rng, 50)} {' '.join(passage.split()[:30])}" for _ in range(5)]
    return list(enumerate(texts)), list(enumerate(clean, 1000)), passage


def test_passages_are_found_and_clean_documents_are_not(spark):
    planted, clean, passage = passage_corpus()
    rows = planted + clean + [(1, planted[1][1]), (5000, None), (5001, ""), (None, planted[2][1])]
    found = passage_dedup.passages(frame(spark, rows)).collect()
    named = {r.id for r in found} | {r.source_id for r in found}
    assert {i for i, _ in planted} <= named
    assert not named & {i for i, _ in clean}
    texts = dict(rows)
    for r in found:
        one = words(planted[2][1] if r.id is None else texts[r.id])
        assert r.end - r.start >= 50 and r.end <= len(one) and r.identity >= 0.8
    # Every document with the passage but the first has all its words in a span.
    whole = [r for r in found if r.id is not None and r.id < 60 and r.end - r.start >= 55]
    assert len({r.id for r in whole}) >= 58


def test_a_passage_stays_once(spark):
    planted, clean, passage = passage_corpus()
    docs = frame(spark, planted + clean + [(5000, None), (5001, "")])
    left = passage_dedup.without_passages(docs)
    assert left.columns == docs.columns
    rows = {r.doc_id: r for r in left.collect()}
    assert sum(passage in (r.text or "") for r in rows.values()) == 1
    for i, text in clean:
        assert rows[i].text == text and rows[i].n_chars == len(text)
    assert rows[5000].text is None and rows[5001].text == ""
    assert all(r.n_chars == len(r.text) for r in rows.values() if r.text)
    assert passage_dedup.without_passages(docs.where("false")).count() == 0


def ordered_by_key(spark, texts):
    """Rows of these texts, with ids that make their keys ascend."""
    tried = [(i, t) for n, t in enumerate(texts) for i in range(1000 * n, 1000 * n + 200)]
    keyed = frame(spark, tried).selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS doc").collect()
    step, rows = 2**64 // len(texts), []
    for n, text in enumerate(texts):
        low = n * step - 2**63
        rows.append(next((r.doc_id, text) for r in keyed if r.text == text and low <= r.doc < low + step))
    return rows


def test_partial_quotes_do_not_hide_a_passage(spark):
    """Two documents that come first quote parts too short to be passages."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    around = lambda part: f"{vocabulary(rng, 70)} {' '.join(part)} {vocabulary(rng, 70)}"
    for quotes in ([(0, 45), (15, 60)],):
        texts = [around(passage[a:b]) for a, b in quotes] + [around(passage) for _ in range(5)]
        rows = ordered_by_key(spark, texts)
        found = passage_dedup.passages(frame(spark, rows)).collect()
        carriers = {i for i, _ in rows[len(quotes) :]}
        assert {r.id for r in found if r.start == 70 and r.end == 130} == carriers - {rows[len(quotes)][0]}
        assert {r.id for r in found} <= carriers
        left = passage_dedup.without_passages(frame(spark, rows)).collect()
        assert sum(" ".join(passage) in r.text for r in left) == 1


def test_quotes_around_the_source_do_not_hide_an_edited_passage(spark):
    """First, and right before, come documents that quote too little of it."""
    rng = random.Random(22)
    passage = [f"p{i}" for i in range(60)]
    other = [f"e{i}" if i in (9, 25, 44) else w for i, w in enumerate(passage)]
    around = lambda part: f"{vocabulary(rng, 70)} {' '.join(part)} {vocabulary(rng, 70)}"
    quotes = [passage[:34], passage[28:]]
    texts = [around(p) for p in (*quotes, other, *quotes, passage, passage)]
    rows = ordered_by_key(spark, texts)
    found = passage_dedup.passages(frame(spark, rows)).collect()
    source, first, second = rows[2][0], rows[5][0], rows[6][0]
    assert [(r.start, r.end, r.source_id, r.source_start) for r in found if r.id == first] == [(70, 130, source, 70)]
    assert {(r.start, r.end) for r in found if r.id == second} == {(70, 130)}
    assert {r.id for r in found} == {first, second}
    left = passage_dedup.without_passages(frame(spark, rows)).collect()
    assert not any(" ".join(passage) in r.text for r in left)


def test_keys_of_two_seeds():
    """Each pair of a document's seeds at the given distance, one of them fresh."""
    rng = np.random.default_rng(3)
    docs = [np.sort(rng.choice(200, 40, replace=False)) for _ in range(5)]
    of, places = np.repeat(np.arange(5), 40), np.concatenate(docs)
    seeds, fresh = rng.integers(0, 30, 200), rng.random(200) < 0.3
    keys, owner = passage_dedup._keys(of, seeds, places, fresh, 15, 54)
    expected = {
        (int(passage_dedup._key(seeds[i : i + 1], seeds[j : j + 1])[0]), int(of[i]))
        for i in range(200)
        for j in range(200)
        if of[i] == of[j] and 15 <= places[j] - places[i] <= 54 and (fresh[i] or fresh[j])
    }
    assert sorted(zip(keys.tolist(), owner.tolist())) == sorted(expected)


def test_a_passage_twice_in_one_document(spark):
    rng = random.Random(23)
    passage = vocabulary(rng, 60)
    around = lambda *parts: " ".join(x for p in parts for x in (vocabulary(rng, 30), p))
    rows = ordered_by_key(spark, [around(passage), around(passage, passage), around(passage[:70], passage)])
    found = passage_dedup.passages(frame(spark, rows)).collect()
    twice, later = rows[1][0], rows[2][0]
    spans = {(r.id, r.start, r.end) for r in found}
    assert {(twice, 30, 90), (twice, 120, 180)} <= spans
    assert any(i == later and b - a == 60 for i, a, b in spans)


@pytest.mark.parametrize("size, percent", [(50, 10), (50, 15), (50, 18), (60, 15), (80, 15)])
def test_edited_passages_make_chains(size, percent):
    rng = np.random.default_rng(size + percent)
    made, trials = 0, 200
    for _ in range(trials):
        some = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
        passage = some(size)
        changed = passage.copy()
        changed[rng.choice(size, size * percent // 100, replace=False)] = some(size * percent // 100)
        places = defaultdict(list)
        for k, y in zip(*(x.tolist() for x in passage_dedup.seeds_of(np.r_[some(40), passage, some(40)]))):
            places[k].append(y)
        other = passage_dedup.seeds_of(np.r_[some(70), changed, some(10)])
        matches = [(x, y) for k, x in zip(*(a.tolist() for a in other)) for y in places[k]]
        made += any(
            len(c) > 1 and c[-1][0] + passage_dedup.KMER - c[0][0] >= passage_dedup.LEAST_CHAIN
            for c in passage_dedup.chains(matches)
        )
    print(size, percent, made / trials)
    assert made >= 0.9 * trials


def test_chains_against_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(60):
        matches = {(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 25))}
        ordered = sorted(matches)
        score = []
        for i, (x, y) in enumerate(ordered):
            earlier = [
                score[j] - 0.125 * (x - a + y - b) for j, (a, b) in enumerate(ordered[:i]) if a < x and b < y
            ]
            score.append(passage_dedup.KMER + max([0, *earlier]))
        chains = passage_dedup.chains(list(matches), longest_gap=10**9)
        assert sorted(m for c in chains for m in c) == ordered
        value = lambda c: passage_dedup.KMER * len(c) - sum(
            0.125 * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(c, c[1:])
        )
        assert abs(max(map(value, chains)) - max(score)) < 1e-9


def test_seeds_of_a_common_run_are_common():
    rng = np.random.default_rng(4)
    run = rng.integers(0, 2**63, 17, dtype=np.uint64)
    for _ in range(50):
        sides = [
            np.concatenate((rng.integers(0, 2**63, 30, dtype=np.uint64), run, rng.integers(0, 2**63, 30, dtype=np.uint64)))
            for _ in range(2)
        ]
        one, other = (set(passage_dedup.seeds_of(s)[0].tolist()) for s in sides)
        assert one & other


def test_pipeline_stages_and_result(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    current = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, folder)
        assert current.columns == docs.columns, name
        rows = current.collect()
        current = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    final = [(r.doc_id, r.text) for r in current.collect()]
    assert len({c for _, n, c in brute(final) if n}) == sum(bool(words(t)) for _, t in final)
    result = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in result.select("doc_id").distinct().collect()} == {i for i, _ in final}


def test_components_of_long_chains(spark):
    rng = random.Random(9)
    nodes = rng.sample(range(10**6), 300)
    links = list(zip(nodes[:150], nodes[1:150])) + [(n, nodes[200]) for n in nodes[201:]] + [(7, 7)]
    frame = spark.createDataFrame([rng.choice([(a, b), (b, a)]) for a, b in links], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    chain, star = min(nodes[:150]), min(nodes[200:])
    assert got == {n: chain for n in nodes[:150]} | {n: star for n in nodes[200:]}
    near = {r.node: r.component for r in star_labels(frame.where("a <> b")).collect()}
    assert all(got[n] == got[c] for n, c in near.items())
    assert components(frame.where("false")).count() == 0


def test_components_in_rounds_and_at_once(spark, monkeypatch):
    rng = random.Random(4)
    links = [(a, a + rng.choice([1, 1, 1, 5])) for a in rng.sample(range(2000), 1200)]
    frame = spark.createDataFrame(links, "a long, b long")
    tracker = spark.sparkContext.statusTracker()

    def found():
        before = len(tracker.getJobIdsForGroup(None))
        got = {r.node: r.component for r in components(frame).collect()}
        return got, len(tracker.getJobIdsForGroup(None)) - before

    at_once, jobs = found()
    assert jobs < 10
    monkeypatch.setattr(components_module, "SOLVED", 3)
    assert found()[0] == at_once and len(at_once) == len({n for link in links for n in link})


def test_shingle_sets_go_with_their_step(spark):
    held = Path(shared_dir(spark).removeprefix("file:"))
    before = set(held.glob("shingle-sets-*"))
    kept = jaccard_join.one_of_each(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]))
    assert {r.doc_id for r in kept.collect()} == {1, 3}
    assert set(held.glob("shingle-sets-*")) == before


def aligned_brute(one, other, least=50, identity=0.8):
    """Words of ``one`` in passages it shares with ``other``, which begin and end
    with an equal word: every pair of places is tried, edits are substitutions."""
    covered = set()
    for shift in range(-len(other) + 1, len(one)):
        low, high = max(0, shift), min(len(one), len(other) + shift)
        equal = [one[i] == other[i - shift] for i in range(low, high)]
        sums = np.cumsum([0, *equal])
        for i in range(len(equal) - least + 1):
            last = i + least - 1
            if equal[i] and equal[last] and sums[last + 1] - sums[i] >= identity * least:
                covered |= set(range(low + i, low + i + least))
    return covered


def test_recall_of_whole_queries(spark):
    """All words that brute force finds in passages of earlier documents."""
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]

    def changed(passage, percent):
        out = list(passage)
        for i in rng.sample(range(len(out)), len(out) * percent // 100):
            out[i] = fresh(1)[0]
        return out

    passages = [fresh(n) for n in (50, 55, 60, 80, 120)]
    texts = []
    for n in range(60):
        parts = []
        for passage in rng.sample(passages, rng.randrange(3)):
            kind = rng.randrange(4)
            part = changed(passage, rng.choice([0, 5, 10, 15])) if kind else passage[: rng.randrange(20, 49)]
            parts += fresh(rng.randrange(60)) + part
        texts.append(parts + fresh(rng.randrange(80)))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    key = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS k").collect()}
    spans = defaultdict(set)
    for r in passage_dedup.passages(docs).collect():
        assert key[r.source_id] < key[r.id]
        spans[r.id] |= set(range(r.start, r.end))
    expected = {
        i: set().union(*(aligned_brute(one, texts[j]) for j in range(60) if key[j] < key[i]))
        for i, one in enumerate(texts)
    }
    total = sum(map(len, expected.values()))
    caught = sum(len(expected[i] & spans[i]) for i in expected)
    extra = sum(len(spans[i] - expected[i]) for i in expected)
    print("recall", caught / total, "beyond", extra / total, "of", total)
    assert total > 2000 and caught >= 0.9 * total and extra <= 0.1 * total


def test_partial_quote_in_the_source_itself(spark):
    """The first document quotes 49 of 60 words before it has the whole passage."""
    rng = random.Random(41)
    pairs = []
    for n in range(6):
        passage = [f"p{n}.{i}" for i in range(60)]
        quote, whole = " ".join(passage[:49]), " ".join(passage)
        source = f"{vocabulary(rng, 40)} {quote} {vocabulary(rng, 40)} {quote} {vocabulary(rng, 30)} {whole} {vocabulary(rng, 9)} {quote}"
        pairs.append([source, f"{vocabulary(rng, 70)} {whole} {vocabulary(rng, 70)}"])
    rows = ordered_by_key(spark, [p[0] for p in pairs] + [p[1] for p in pairs])
    found = {(r.id, r.start, r.end) for r in passage_dedup.passages(frame(spark, rows)).collect()}
    assert {(i, 70, 130) for i, _ in rows[6:]} <= found


def test_hot_seeds_are_resolved_in_their_batch(spark, monkeypatch):
    """A text of one word, a line in every document and a passage in many."""
    rng = random.Random(43)
    line, passage = vocabulary(rng, 25), vocabulary(rng, 55)
    texts = ["again " * 3000, "again " * 2000 + vocabulary(rng, 50)]
    texts += [f"{vocabulary(rng, 30)} {line} {vocabulary(rng, 30)}" for _ in range(150)]
    texts += [f"{vocabulary(rng, 30)} {passage} {vocabulary(rng, 30)}" for _ in range(40)]
    docs = frame(spark, list(enumerate(texts)), 3)
    once = {(r.id, r.start, r.end) for r in passage_dedup.passages(docs).collect()}
    monkeypatch.setattr(passage_dedup, "HOT_LEAST", 32)
    monkeypatch.setattr(passage_dedup, "HOT_SHARE", 500)
    hot = {(r.id, r.start, r.end) for r in passage_dedup.passages(docs).collect()}
    for found in (once, hot):
        assert len({i for i, a, b in found if i >= 152 and b - a >= 55}) == 39
        assert not {i for i, _, _ in found if 2 <= i < 152}
        assert len({i for i, _, _ in found if i < 2}) == 1


def test_helper_names_in_the_input_and_long_texts(spark):
    rng = random.Random(47)
    long = " ".join(vocabulary(rng, 1000) for _ in range(30))
    passage = vocabulary(rng, 60)
    rows = [(1, f"{long} {passage}", 5, "k", "o"), (2, f"{passage} tail of it", 6, "k", "o"), (3, None, 7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __KEY string, __own string")
    left = {r.doc_id: r for r in passage_dedup.without_passages(docs).collect()}
    assert sum(passage in (r.text or "") for r in left.values()) == 1 and left[3]["__id"] == 7
    assert passage_dedup.without_passages(docs).columns == docs.columns
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_texts_are_stored_and_not_whole_sets(spark):
    """Eight bytes a shingle would take more room than the texts themselves."""
    rng = random.Random(8)
    rows = [(i, vocabulary(rng, 400)) for i in range(300)]
    path = Path(shared_dir(spark), "stored-sets-of-a-test")
    sets = jaccard_join.shingle_sets(frame(spark, rows), "doc_id", "text", path=str(path))
    assert sum(r.n for r in sets.collect()) == 300 * 396
    assert sum(p.stat().st_size for p in path.rglob("*.parquet")) < 8 * 300 * 396


def test_texts_are_cut_in_one_pass(spark):
    """The cutting function ran for the filter and again for the result."""
    rng = random.Random(9)
    passage = vocabulary(rng, 80)
    rows = [(i, f"{vocabulary(rng, 30)} {passage} {vocabulary(rng, 30)}") for i in range(4)]
    kept = passage_dedup.without_passages(frame(spark, rows))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r.n_chars == len(r.text) for r in kept.collect()) == [True] * 4
    assert sum(passage in r.text for r in kept.collect()) == 1
