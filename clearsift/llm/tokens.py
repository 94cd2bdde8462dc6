"""Token ids of whole texts, as little-endian 32-bit words.

The tokenizer is a vocabulary file of its own library; only its words are
remembered between texts.  A word of a plain Latin text is looked up in a
bounded store, unknown words of a batch are encoded together, and every other
text goes to the tokenizer whole, so ids are always the tokenizer's own.  The
store has two halves: when the newer is full it becomes the older, and words of
the older that are met again move over, so words in use are never forgotten.
"""

import os
import re

import numpy as np

STORE_WORDS = 300_000
# Unknown words encoded in one call; longer texts cost it more a word.
LEARNED = 500
# Splits plain texts as the tokenizer itself does; other texts never come here.
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
# Anything but printable ASCII, ASCII white space and letters of Latin-1 and
# Latin Extended-A whose lower case is one letter.
_OTHER = re.compile(
    "[^\x09-\x0d\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]"
).search
_stores = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids by a word-based BPE file: lower case, white space dropped."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        # The same model for words that are split and lower-cased already.
        self._words = Tokenizer(self._whole.model)
        self._words.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self._ends = np.zeros(self._whole.get_vocab_size(), dtype=bool)
        for token, number in self._whole.get_vocab().items():
            self._ends[number] = token.endswith("</w>")
        self._known, self._older = {}, {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(
            self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4"
        )

    def _learn(self, words: list[str]) -> None:
        for start in range(0, len(words), LEARNED):
            part = words[start : start + LEARNED]
            encoded = self._words.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(encoded[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) != len(part):
                for word in part:
                    self._known[word] = self._encode(word).tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for word, cut in zip(part, (cuts * 4).tolist()):
                self._known[word] = raw[at:cut]
                at = cut

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty.  Bounded batches expected."""
        split = []
        for text in texts:
            plain = text is not None and "<|" not in text and not _OTHER(text)
            split.append(_UNITS(text.lower()) if plain else None)
        asked = set().union(*(s for s in split if s))
        missing = asked.difference(self._known)
        if missing:
            if len(self._known) + len(missing) > STORE_WORDS // 2:
                self._older, self._known, missing = self._known, {}, asked
            known, older = self._known, self._older
            for word in missing.intersection(older):
                known[word] = older[word]
            self._learn(sorted(missing.difference(known)))
        get = self._known.__getitem__
        out = []
        for text, units in zip(texts, split):
            if units is not None:
                out.append(b"".join(map(get, units)))
            else:
                out.append(self._encode(text).tobytes() if text else b"")
        return out


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each path and worker process."""
    if path not in _stores:
        _stores[path] = WordTokenizer(path)
    return _stores[path]


def encoded_rows(batches, path: str, end_id: int, batch_chars: int = 1 << 20):
    """``(id, ids)`` of Arrow batches with columns ``id`` and ``text``; the end
    id is appended.  Texts are encoded in groups of about ``batch_chars``."""
    import pyarrow.compute as pc

    encoder, end = tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        start = 0
        while start < len(ids):
            floor = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, floor + batch_chars, "right")))
            part = texts.slice(start, stop - start).to_pylist()
            for key, raw in zip(ids[start:stop], encoder.encode(part)):
                yield key, raw + end
            start = stop
