"""Best paths of many words at once, in numpy.

Words of one length advance together: the hashes of all their substrings probe the sorted hashes of the pieces, and at each
end position one vectorised maximum over the piece lengths stores the back-pointers. A long word is walked
alone, from start to start over the pieces found there, in blocks. Equal sums go to the earliest start. Substrings are told apart by 64-bit hashes.
"""

from __future__ import annotations

from array import array

import numpy as np

from ..functions.probing import Sorted, codes, extend, mix, string_hashes

#: Substrings that are looked up at once, and the length from which a word is walked alone.
BLOCK = 1 << 19
LONG = 512


class Lattice:
    """Scored pieces (text, score, index).

    unknown None: a character at which no piece ends costs nothing and sets the sum back to zero; sums are in single precision. A
    number: a character that is no piece is a node of that score; sums are in double precision. Such nodes have the index given by missing.
    """

    def __init__(self, texts: list[str], scores: list[float], index: list[int], unknown: float | None = None, missing: int = 0):
        self.unknown, self.missing = unknown, missing
        self.kind = np.float32 if unknown is None else np.float64
        self.longest = max(map(len, texts), default=1)
        hashes = string_hashes(texts)
        order = np.argsort(hashes)
        self.keys = Sorted(hashes[order])
        self.score = np.append(np.array(scores, dtype=self.kind)[order], self.kind(-np.inf))
        self.index = np.append(np.array(index, dtype=np.int32)[order], np.int32(missing))

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edges, starts, ends, indices, sums): the nodes of all words' best paths, one word after the other, where each word's begin, and
        the sum at each word's end."""
        sums = np.zeros(len(words), dtype=np.float64)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        parts = [np.zeros((4, 0), dtype=np.int64)]
        for n, group in by_length.items():
            if n >= LONG:
                for i in group:
                    found, sums[i] = self._walk(words[i])
                    parts.append(np.concatenate([np.full((1, found.shape[1]), i), found]))
            elif n:
                most = max(1, BLOCK // (n * min(n, self.longest)))
                for at in range(0, len(group), most):
                    own = np.array(group[at : at + most])
                    (who, *found), sums[own] = self._advance(codes([words[i] for i in own]))
                    parts.append(np.stack([own[who], *found]))
        flat = np.concatenate(parts, axis=1)
        flat = flat[:, np.argsort(flat[0], kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(flat[0], minlength=len(words)))])
        return edges, flat[1], flat[2], flat[3], sums

    def _advance(self, c: np.ndarray) -> tuple[tuple, np.ndarray]:
        """Nodes (word, start, end, index) of the words in the rows of c, each word's in order, and the words' sums."""
        g, n = c.shape
        most = min(n, self.longest)
        score = np.full((most, g, n), -np.inf, dtype=self.kind)  # by piece length, word and start
        piece = np.full((most, g, n), self.missing, dtype=np.int32)
        h = np.zeros_like(c)
        for k in range(most):
            h = extend(h[:, : n - k], c[:, k:])
            at = self.keys.find(mix(h))
            score[k, :, : n - k], piece[k, :, : n - k] = self.score[at], self.index[at]
        if self.unknown is not None:
            score[0][np.isneginf(score[0])] = self.unknown
        total = np.zeros((g, n + 1), dtype=self.kind)
        back = np.zeros((g, n + 1), dtype=np.int32)
        rows = np.arange(g)
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - most), end)
            sums = total[:, starts] + score[end - 1 - starts, :, starts].T
            first = np.argmax(sums, axis=1)
            best = sums[rows, first]
            none = np.isneginf(best)
            total[:, end] = np.where(none, self.kind(0), best)
            back[:, end] = np.where(none, end - 1, starts[first])
        steps, place, alive = [], np.full(g, n), rows
        while len(alive):
            end, start = place[alive], back[alive, place[alive]]
            steps.append((alive, start, end, piece[end - start - 1, alive, start]))
            place[alive] = start
            alive = alive[start > 0]
        who, start, end, index = (np.concatenate([s[k] for s in steps[::-1]]) for k in range(4))
        order = np.argsort(who, kind="stable")
        return (who[order], start[order], end[order], index[order]), total[:, n]

    def _walk(self, word: str) -> tuple[np.ndarray, float]:
        """Nodes (start, end, index) of one word, and its sum."""
        n = len(word)
        best, back, index = array("f" if self.unknown is None else "d", bytes((4 if self.unknown is None else 8) * (n + 1))), [-1] * (n + 1), [self.missing] * (n + 1)
        cell = array(best.typecode, [0.0])
        step = max(1, BLOCK // self.longest)
        c = codes([word])[0]
        for a in range(0, n, step):
            b = min(a + step, n)
            starts, ends, scores, found = [], [], [], []
            h = np.zeros(b - a, dtype=np.uint64)
            for k in range(min(self.longest, n - a)):
                m = min(b, n - k) - a
                h = extend(h[:m], c[a + k : a + k + m])
                at = self.keys.find(mix(h))
                hit = np.flatnonzero(at >= 0)
                if k == 0 and self.unknown is not None:
                    alone = np.flatnonzero(at < 0)
                    starts.append(a + alone), ends.append(a + alone + 1), scores.append(np.full(len(alone), self.unknown)), found.append(np.full(len(alone), self.missing))
                starts.append(a + hit), ends.append(a + hit + k + 1), scores.append(self.score[at[hit]].astype(np.float64)), found.append(self.index[at[hit]])
            flat = [np.concatenate(x) for x in (starts, ends, scores, found)]
            order = np.argsort(flat[0], kind="stable")
            s, before = -1, 0.0
            for start, end, score, i in zip(*(x[order].tolist() for x in flat)):
                if start != s:
                    for s in range(s + 1 if s >= 0 else a, start + 1):
                        if s and back[s] < 0:  # no piece ends here
                            back[s], best[s] = s - 1, 0.0
                    before = best[start]
                cell[0] = before + score
                if back[end] < 0 or cell[0] > best[end]:
                    best[end], back[end], index[end] = cell[0], start, i
            for s in range(max(s + 1, a), b):
                if s and back[s] < 0:
                    back[s], best[s] = s - 1, 0.0
        if back[n] < 0:
            back[n], best[n] = n - 1, 0.0
        out, end = [], n
        while end:
            out.append((back[end], end, index[end]))
            end = back[end]
        return np.array(out[::-1], dtype=np.int64).reshape(-1, 3).T, best[n]
