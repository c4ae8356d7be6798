"""Vectorised hashing of words and shingles, in numpy.

Word hashes are differences of prefix sums of a polynomial over random byte values modulo 2**64: one pass
over the bytes whatever the number of words. All constants are derived from fixed seeds, so every worker
computes the same hashes.
"""

from __future__ import annotations

import re

import numpy as np

from ..functions.probing import Sorted, mix

__all__ = ["Sorted", "mix", "text_words", "word_hashes", "fold", "shingle_set", "spans", "chunks"]

_rng = np.random.default_rng(20240611)
#: Random odd multipliers and byte values.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13 | 1
_M = [int(x) | 1 for x in _rng.integers(1 << 61, 1 << 63, 16)]
#: Bytes that are hashed at once, so that a worker's tables and temporary arrays stay small.
CHUNK = 1 << 18

#: Byte -> whether it belongs to a word, for words [^\x20\x09-\x0D]+ of UTF-8 text.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _INV = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None or len(_POW) < n:
        size = max(CHUNK, 1 << (n - 1).bit_length())
        _POW, _INV = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW, _INV


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs where inside[data] holds."""
    flag = np.zeros(len(data) + 2, dtype=np.int8)
    flag[1:-1] = inside[data]
    edge = np.diff(flag)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; data is one chunk of bytes (uint8)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def fold(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n consecutive hashes."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * np.uint64(_M[k])
    return mix(out)


def chunks(texts: list[bytes], most: int = CHUNK):
    """Groups of neighbouring texts of at most about ``most`` bytes, each (texts, whether they end their text); a longer text comes
    in parts that are cut between words, so that only a single longer word makes a longer group."""
    group, ends, size = [], [], 0
    for t in texts:
        if size and size + len(t) > most:
            yield group, ends
            group, ends, size = [], [], 0
        at = 0
        while len(t) - at > most:
            end = _gap(t, at + most)
            if end is None:
                break
            yield [t[at:end]], [False]
            at = end
        group.append(t[at:] if at else t)
        ends.append(True)
        size += len(t) - at + 1
    if group:
        yield group, ends


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _gap(text: bytes, at: int) -> int | None:
    """The first place from at on where white space begins."""
    found = _SPACE.search(text, at)
    return found.start() if found else None


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after the other, and where each text's words start (one more than texts)."""
    hashes, counts, open_words = [], [np.zeros(1, dtype=np.int64)], 0
    for group, ends in chunks(texts):
        data = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
        starts, stops = spans(data, WORD)
        hashes.append(word_hashes(data, starts, stops))
        edges = np.cumsum([len(t) + 1 for t in group])
        n = np.diff(np.searchsorted(starts, edges), prepend=0)
        n[0] += open_words
        if ends[-1]:
            counts.append(n)
            open_words = 0
        else:
            open_words = n[0]
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), np.cumsum(np.concatenate(counts))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of n-word shingles, sorted; with fewer words, the whole sequence as one; without words, none."""
    if len(words) >= n:
        return np.unique(fold(words, n))
    return fold(words, len(words)) + np.uint64(len(words)) if len(words) else words
