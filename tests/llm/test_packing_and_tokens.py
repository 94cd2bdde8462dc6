"""Packing, token ids and their round trips."""

import random
import zlib

import numpy as np
import pytest

from clearsift.llm import packing
from clearsift.llm.tokens import WordTokenizer, default_path

TEXTS = [
    "Hello, World! it's 42 o'clock's", "", None, " \n\t ", "é ß ö Ärger ñandú", "I'LL We'Re 'tis can't",
    "<|endoftext|> x <|startoftext|>", "中文 字符 mixed 12", "a\u0301 e\u0301 İstanbul ŉ Σίσυφος", "tabs\x1cunit\x85next",
    "___ under_score -- *** $$$", "²³ ½ Ⅷ", "x" * 3000, "word " * 6000, "\u200b\ufeff zero", "don't've", "naïve'd",
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers_own(whole, monkeypatch):
    random.seed(3)
    letters = "abc XYZ ßéŠ'.,!#09\n\t_-²漢"
    texts = TEXTS + ["".join(random.choices(letters, k=random.randint(1, 80))) for _ in range(400)]
    monkeypatch.setattr("clearsift.llm.tokens.STORE_WORDS", 50)
    coder = WordTokenizer(default_path())
    for start in range(0, len(texts), 40):
        part = texts[start : start + 40]
        for text, raw in zip(part, coder.encode(part)):
            assert np.frombuffer(raw, "<u4").tolist() == whole(text), text


def documents(spark, texts, partitions=2):
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, sequence_id string, length int"
    ).repartition(partitions)


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_balanced_pieces_hold_every_id_once(spark, whole, block):
    texts = TEXTS + ["some more words here"] * 9
    rows = packing.cost_balanced(
        documents(spark, texts), capacity=64, block_tokens=block
    ).collect()
    ids = {None if i == 3 else i: [*whole(t), 1] for i, t in enumerate(texts)}
    found, sequences = {}, {}
    for r in rows:
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        found.setdefault(r.doc_id, []).append((r.start, piece))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sum((p for _, p in sorted(v)), []) for k, v in found.items()} == ids
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    if block > 300:
        assert sum(map(len, ids.values())) / (64 * len(sequences)) > 0.97
    empty = packing.cost_balanced(documents(spark, TEXTS).where("false"))
    assert empty.count() == 0


def test_costs_are_balanced_and_every_length_fits():
    random.seed(5)
    lengths = [random.choice([1, 5, 300, 900, 2048, 2049, 7000]) for _ in range(3000)]
    pieces = packing.balanced_pieces(lengths, 2048, 1.0, 1 / 1024)
    load, cost = {}, {}
    for doc, start, n, s, offset in pieces:
        assert offset == load.get(s, 0)
        load[s] = offset + n
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    assert sum(load.values()) == sum(lengths) and max(load.values()) <= 2048
    assert sum(lengths) > 0.999 * 2048 * (len(load) - 1)
    mixed = [c for s, c in cost.items() if c != 2048 + 4096]
    assert np.std(mixed) < 0.25 * np.mean(mixed)


def test_best_fit_equals_a_plain_search():
    random.seed(6)
    for _ in range(30):
        capacity = random.choice([7, 16, 100])
        lengths = [random.randint(1, 3 * capacity) for _ in range(random.randint(0, 120))]
        parts = sorted(
            (-min(capacity, n - a), d, a) for d, n in enumerate(lengths) for a in range(0, n, capacity)
        )
        room, plain = [], []
        for size, _, _ in parts:
            fits = [r for r in room if r >= -size]
            if fits:
                room.remove(min(fits))
            best = min(fits) if fits else capacity
            plain.append(best)
            room.append(best + size)
        pieces = packing.best_fit_pieces(lengths, capacity)
        assert [capacity - p[4] for p in pieces] == plain
        assert all(p[4] + p[2] <= capacity for p in pieces)


def test_matrix_rows_read_back(spark, whole, tmp_path):
    packed = packing.best_fit(documents(spark, TEXTS), capacity=64)
    packing.write_packed(packed, str(tmp_path / "packed"))
    ids = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        row, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(row) == len(places) == 64
        for a, b, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.segments):
            assert b - a == s.length and places[a:b].tolist() == list(range(s.length))
            ids.setdefault(s.doc_id, []).append((s.start, row[a:b].tolist()))
        assert not row[r.cu_seqlens[-1] :].any() and not places[r.cu_seqlens[-1] :].any()
    got = {k: sum((p for _, p in sorted(v)), []) for k, v in ids.items()}
    assert got == {None if i == 3 else i: [*whole(t), 49407] for i, t in enumerate(TEXTS)}


def test_query_checksums_follow_the_ids(spark, whole):
    from clearsift.llm import queries  # noqa: F401  (importing registers)
    from clearsift.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op6_cost_balanced_packing"](spark, folder).collect()
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.array([*whole(texts[r.doc_id]), 1], dtype="<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    matrix = QUERIES["op9_best_fit_token_matrix"](spark, folder).collect()
    assert sum(r.n_tokens for r in matrix) == sum(len(whole(t)) + 1 for t in texts.values())
