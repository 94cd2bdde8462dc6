"""Hashes of words and of word shingles, a text at a time with NumPy."""

import hashlib

import numpy as np

_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
SEGMENT = 1 << 20
_blank = np.zeros(256, dtype=bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_powers = {}


def _power(base: int, many: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < many:
        held = np.full(max(many, 1 << 14), np.uint64(base), dtype=np.uint64)
        held[0] = 1
        _powers[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:many]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _word_spans(data: np.ndarray):
    blank = _blank[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edges = np.concatenate(([0], edges))
    if len(data) and not blank[-1]:
        edges = np.concatenate((edges, [len(data)]))
    return edges[::2], edges[1::2]


def word_spans(raw: bytes):
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    return _word_spans(np.frombuffer(raw, dtype=np.uint8))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, A-Z lower-cased."""
    whole = np.frombuffer(raw, dtype=np.uint8)
    parts, at = [], 0
    while at < len(whole):
        stop = min(at + SEGMENT, len(whole))
        while stop < len(whole):  # a segment ends before a blank
            ahead = np.flatnonzero(_blank[whole[stop : stop + 4096]])
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + 4096, len(whole))
            if len(ahead):
                break
        data = _lower[whole[at:stop]]
        starts, ends = _word_spans(data)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_RADIX, len(data)), out=sums[1:])
        sums = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
        parts.append(mix(sums + (ends - starts).astype(np.uint64)))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` word hashes, in order."""
    many = len(words) - size + 1
    if many < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(many, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        total = total * _JOIN + words[i : i + many]
    return mix(total)


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingles as signed 64-bit numbers.  Fewer words than
    ``size`` are one shingle; no words are none."""
    words = word_hashes(raw) if raw else ()
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    return np.unique(window_hashes(words, min(size, len(words))).view(np.int64))


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()
