"""Quality rules and decontamination against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

from clearsift.llm import decontamination, quality_rules

SCHEMA = (
    "doc_id long, text string, source string, n_chars long, words string, frequent string,"
    " spans string, pos int, line string, n_words string, kept string"
)


def frame(spark, rows, partitions=3):
    """Documents with columns whose names clash with internal ones."""
    full = [(i, t, s, len(t or ""), *["x"] * 3, 7, "x", "x", "x") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def numbered(start, n):
    return " ".join(f"w{start + i}" for i in range(n))


def expected_quality(rows):
    lines, hosts = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower()
    for _, text, host in rows:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                lines[host, norm(line)].add(text)
    out = []
    for i, text, host in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        times = Counter(windows)
        repeated = {j + k for j, w in enumerate(windows) if times[w] > 1 for k in range(8)}
        worded = [x for x in text.split("\n") if norm(x)]
        gone = 0
        for line in worded:
            n = len(lines[host, norm(line)])
            if n > 10 and 100 * n > 2 * len(hosts[host]):
                gone += len(norm(line).split(" "))
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        out.append(
            (
                i, len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)),
                len(worded) - len(set(worded)), len(repeated), failed,
                not failed and 100 * (len(words) - gone) >= 20 * len(words),
            )
        )
    return sorted(out, key=repr)


def quality_rows():
    shared = "Shared Line of the host, in many places"
    rows = [(i, f"{numbered(100 * i, 25)}\n{shared.upper()}  ", "a") for i in range(14)]
    # Nothing but the frequent line, many times, and a little else: depleted.
    rows += [(50, "\n".join(f" {shared}" for _ in range(1)) + "\n" + numbered(9, 14), "a")]
    rows += [(51, f"{shared}\n{numbered(9, 1)}\nq r s t u v w x y z 1 2 3 4 5 6 7", "b")]
    rows += [(52, shared + "\n" + " ".join(f"{shared} {k}" for k in range(2)), "a")]
    copy = numbered(5000, 30) + "\nowned by copies only"
    rows += [(60 + i, copy, "a") for i in range(30)]  # copies count once
    rows += [(1, None, None), (None, "", "a"), (2, " \t\n\x0b ", "b"), (3, "one", None)]
    rows += [(4, "a b c d e f g h i " * 9, "b"), (4, "a b c d e f g h i " * 9, "b")]
    rows += [(5, "x " * 40 + numbered(0, 200), "b"), (6, "é\u00a0ü #*$ <b> " + numbered(0, 30), "b")]
    rows += [(7, numbered(0, 60_000) + "\n" + numbered(0, 9), "b")]
    rows += [(8, "same\nsame\n same\n\n\nsame", "b")]
    return rows


def test_quality_rules_match_plain_python(spark):
    rows = quality_rows()
    judged = quality_rules.judge(frame(spark, rows))
    assert set(judged.columns) >= {"words", "frequent", "spans", "pos", "line", "clean_text"}
    got = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    ).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_quality(rows)


def test_depleted_documents_and_frequent_lines(spark):
    line = "read more on our pages about this and that and all of it every day"
    rows = [(i, f"{numbered(100 * i, 30)}\n{line}", "a") for i in range(12)]
    mostly = "\n".join([line] * 1) + " extra"
    rows += [(99, f"{line}\n {line.upper()}\nk1 k2 k3", "a"), (98, mostly + " " + numbered(0, 30), "a")]
    judged = {
        r.doc_id: r
        for r in quality_rules.judge(frame(spark, rows), repeat_percent=100, left_percent=20).collect()
    }
    assert not judged[99].kept and judged[99].clean_text == "k1 k2 k3"
    assert judged[98].kept and judged[98].n_frequent_words == 0
    assert all(judged[i].kept and judged[i].clean_text == numbered(100 * i, 30) for i in range(12))
    assert quality_rules.judge(frame(spark, []).where("false")).count() == 0


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected_hits(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add("" if item is None else str(item))
    out = []
    for i, text, *_ in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest))
    return sorted(out, key=repr)


def decontamination_case():
    passage = numbered(0, 24)
    items = [(1, passage), (2, passage.upper()), (30, numbered(500, 12)), (4, "Tiny ITEM"), (5, None)]
    items += [(6, " . "), (None, numbered(900, 11)), (1, passage)]
    docs = [
        (1, f"before {passage}, after", "a"),
        (2, numbered(0, 9), "a"),
        (3, f"{numbered(3, 10)} cut {numbered(8, 12)}-{numbered(500, 12)}", "a"),
        (4, "a tiny--item, here tiny item", "b"),
        (5, None, "b"), (6, "", None), (None, passage, "b"), (7, f"É{passage}", "b"),
        (8, numbered(2000, 5000) + " " + passage + " " + numbered(2000, 5000), "b"),
        (9, numbered(900, 11), "b"), (9, numbered(900, 11), "b"), (10, "clean words", "b"),
        (11, (passage + " . ") * 40, "c"),
    ]
    return docs, items


def test_decontamination_matches_plain_python(spark):
    docs, items = decontamination_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(frame(spark, docs), benchmark, ["doc_id"]).selectExpr(
        "doc_id", "n_words", "n_hit", "size(items)", "sha2(array_join(items, ','), 256)"
    )
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_hits(docs, items)
    none = benchmark.where("false")
    assert decontamination.scan(frame(spark, docs), none, ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontamination.scan(frame(spark, docs).where("false"), benchmark, ["doc_id"]).count() == 0


def test_documents_or_spans_are_removed(spark):
    docs, items = decontamination_case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    source = frame(spark, docs)
    left = decontamination.clean(source, benchmark)
    assert left.columns == source.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [10, 2, 5, 6]
    spans = {
        r.doc_id: r.text for r in decontamination.clean(source, benchmark, remove="spans").collect()
    }
    assert spans[1] == "before after" and spans[4] == "a here " and spans[10] == "clean words"
    assert spans[5] is None and spans[3] == "cut "
    again = frame(spark, [(i, t, "a") for i, t in spans.items()])
    assert decontamination.scan(again, benchmark, ["doc_id"]).where("n_hit > 0").count() <= 1
