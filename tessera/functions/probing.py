"""Vectorised hashing of code points and probing of sorted hash arrays, in numpy."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x2545F4914F6CDD1D)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def codes(words: list[str]) -> np.ndarray:
    """Code points of equally long words, one row each; lone surrogates count as they are."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The unmixed hashes of strings of which h are those without the last characters c."""
    return h * _STEP + c + np.uint64(1)


def string_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.zeros(len(words), dtype=np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        c, h = codes([words[i] for i in at]), np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h = extend(h, c[:, k])
        out[at] = mix(h)
    return out


class Sorted:
    """Sorted distinct hashes with a directory over their upper bits: probes cost a few vectorised steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, min(20, int(len(keys)).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        ends = np.append(self.first[1:], len(keys))
        self.run = int((ends - self.first).max()) if len(keys) else 0
        self.padded = np.append(keys, np.zeros(self.run + 1, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash among the keys, or -1."""
        out = np.full(hashes.shape, -1, dtype=np.int32)
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        for _ in range(self.run):
            hit = (self.padded[at] == hashes) & (at < len(self.keys))
            np.copyto(out, at, where=hit)
            at = at + np.int32(1)
        return out
