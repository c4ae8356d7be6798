"""Subword segmentation: cleaning and normalization with positions, best path, unknown runs, masks.

Run in Arrow batches by ``tokenize``. Scores are added in single precision, and a character no
piece covers sets the score of the path back to zero, so segmentations are those of the tokenizer the
models were made for. Positions are code points of the input.

Ids of whole texts are made word by word, each distinct word once and all of a length together (``lattice``), wherever that provably equals
the path over the whole text: markers only lead words, each character of a piece is a piece, and no sum up to the text's
end can round. Other texts are walked whole.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np

from ..functions.charclass import CONTROL, CONTROL_RANGES, MARKER, REPLACEMENT, WHITESPACE, WHITESPACE_SET, is_dropped
from ..schema import Mask
from ..sources.protowire import Piece, read_model
from ..sources.vocab import SpecialTokens, Vocab
from .lattice import Lattice

#: Words that a worker remembers.
WORDS = 200_000
_TRAILING = re.compile(r"\s+\Z")
_SPACE = re.compile("[" + "".join(map(chr, WHITESPACE)) + "]")
_DROPPED = re.compile("[" + "".join(map(re.escape, map(chr, (*CONTROL, REPLACEMENT)))) + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in CONTROL_RANGES) + "]")


class Pieces:
    """Scored pieces with a look-up that knows prefixes; the index is the place in the file, 0 meaning unknown."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.table: dict[str, tuple[float, int] | None] = {}
        self._lattice: Lattice | None = None
        for i, (text, score) in enumerate(pieces):
            for k in range(1, len(text)):
                self.table.setdefault(text[:k])
            if text:
                self.table[text] = (score, i)

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        return cls([(p.text, p.score) for p in read_model(path).pieces])

    def prefixes(self, text: str, start: int = 0) -> list[tuple[str, float, int]]:
        """All pieces at the start of text[start:], shortest first."""
        out = []
        for end in range(start + 1, len(text) + 1):
            part = text[start:end]
            if part not in self.table:
                break
            hit = self.table[part]
            if hit:
                out.append((part, *hit))
        return out

    @property
    def lattice(self) -> Lattice:
        """The pieces as sorted hashes; made where it is used, not shipped."""
        if self._lattice is None:
            found = [(t, *hit) for t, hit in self.table.items() if hit]
            self._lattice = Lattice([t for t, _, _ in found], [x for _, x, _ in found], [i for _, _, i in found])
        return self._lattice

    def __getstate__(self) -> dict:
        return {"table": self.table, "_lattice": None}

    def best_path(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, index) of the nodes of the best path; equal sums go to the earliest start."""
        _, starts, ends, index, _ = self.lattice.paths([text])
        return list(zip(starts.tolist(), ends.tolist(), index.tolist()))

    def exact_below(self) -> float:
        """Sums of scores whose absolute value stays below this do not round in single precision: all scores are multiples of one power of two."""
        scores = np.array([hit[0] for hit in self.table.values() if hit and hit[0]], dtype=np.float32).astype(np.float64)
        if not len(scores):
            return np.inf
        whole, exponent = np.frexp(scores)
        bits = (whole * (1 << 24)).astype(np.int64)
        least = int((exponent + np.round(np.log2((bits & -bits).astype(np.float64)))).min()) - 24
        return float(2.0 ** (least + 24))

    def closed(self, apart=()) -> bool:
        """Whether words can be segmented alone: markers only lead, and each character of a piece is a piece.

        Pieces in apart, special tokens that texts are cut at, do not count.
        """
        whole = [t for t, hit in self.table.items() if hit and t not in apart]
        return all(MARKER not in t[1:] for t in whole) and all(self.table.get(c) for t in whole for c in t)


def clean(text: str, refs: list[int]) -> tuple[str, list[int]]:
    kept = [(" " if c in WHITESPACE_SET else c, r) for c, r in zip(text, refs) if not is_dropped(c)]
    return "".join(c for c, _ in kept), [r for _, r in kept]


def nfkc(text: str, refs: list[int]) -> tuple[str, list[int]]:
    """Normalized text and positions: each character moves on by one, one that the text did not hold also by how much longer it is in UTF-8 than in UTF-16."""
    if text.isascii():
        return text, refs
    norm = unicodedata.normalize("NFKC", text)
    old, out, at = set(text), [], 0
    for c in norm:
        out.append(refs[at] if at < len(refs) else refs[-1] if refs else 0)
        at += 1
        if c not in old:
            at += len(c.encode("utf-8", "replace")) - len(c.encode("utf-16-le", "replace")) // 2
    return norm, out


def lower(text: str) -> str:
    """Lower case, one code point for each."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Token:
    text: str
    refs: list[int]
    mask: int = Mask.NONE


def split_special(text: str, refs: list[int], specials: list[str], unk: str | None) -> list[Token]:
    """Cuts at special tokens, leftmost first, then in their order; text before one loses trailing white space."""
    if not specials:
        return [Token(text, refs)]
    out, at = [], 0
    for m in re.finditer("|".join(map(re.escape, specials)), text):
        before = _TRAILING.sub("", text[at : m.start()])
        if before:
            out.append(Token(before, refs[at : at + len(before)]))
        out.append(Token(m[0], refs[m.start() : m.end()], Mask.UNKNOWN if m[0] == unk else Mask.SPECIAL))
        at = m.end()
    if at < len(text):
        out.append(Token(text[at:], refs[at:]))
    return out


def merge_unknown(nodes: list[Token], unknown: list[bool]) -> list[Token]:
    """Runs of unknown nodes become one token, with the positions of the last and, if it is a run, the mask Unknown."""
    out: list[Token] = []
    for is_unknown, run in groupby(zip(nodes, unknown), key=lambda x: x[1]):
        run = [node for node, _ in run]
        if is_unknown and len(run) > 1:
            run = [Token("".join(t.text for t in run), run[-1].refs, Mask.UNKNOWN)]
        out += run
    return out


def kind(token: str) -> int:
    """The mask that a token asks for by itself: punctuation, white space, a continuation, or none."""
    if len(token) == 1 and ord(token) <= 0xFFFF:
        if unicodedata.category(token).startswith("P"):
            return Mask.PUNCTUATION
        if token.isspace():
            return Mask.WHITESPACE
    return Mask.NONE if token[:1] == MARKER else Mask.CONTINUATION


def populate_masks(tokens: list[Token]) -> list[Token]:
    """Each token's mask follows from its own kind and the kind before: after punctuation or white space nothing continues, and a token
    that does not continue keeps the mask it has."""
    kinds = [kind(t.text) for t in tokens]
    for t, own, before in zip(tokens, kinds, [Mask.NONE, *kinds]):
        starts = own == Mask.CONTINUATION and before in (Mask.PUNCTUATION, Mask.WHITESPACE)
        t.mask = t.mask if starts or own == Mask.NONE else own
    return tokens


@dataclass
class Tokenizer:
    """A vocabulary and scored pieces; picklable, shipped to workers in a broadcast.

    prefix_ref "text" gives the marker put before a segment position 0, "segment" the position of its first
    character. paired: ``encode`` puts the pair template around its sequences.
    """

    vocab: Vocab
    pieces: Pieces
    lowercase: bool = False
    prefix_ref: str = "text"
    paired: bool = True
    _words: dict[str, tuple[bytes, float]] = field(default_factory=dict, repr=False)
    _ids: np.ndarray | None = field(default=None, repr=False)
    _limit: float | None = field(default=None, repr=False)
    _highest: float = field(default=0.0, repr=False)

    def __getstate__(self) -> dict:
        """What a worker remembers is not shipped."""
        return self.__dict__ | {"_words": {}, "_ids": None, "_limit": None}

    @classmethod
    def from_file(cls, path: str, lowercase: bool = False, specials: str | None = None) -> Tokenizer:
        known = SpecialTokens.from_json(specials) if specials else None
        return cls(Vocab.from_sentencepiece(path, known), Pieces.from_file(path), lowercase)

    @classmethod
    def from_pieces(cls, pieces: list[Piece], lowercase: bool = False) -> Tokenizer:
        return cls(Vocab.pair_layout(pieces), Pieces([(p.text, p.score) for p in pieces]), lowercase)

    def normalized(self, text: str, refs: list[int]) -> tuple[str, list[int]]:
        first = refs[0] if refs else 0
        text, refs = nfkc(*clean(text, refs))
        if self.lowercase:
            text = lower(text)
        text = "".join(MARKER if c in WHITESPACE_SET else c for c in text)
        if not text.startswith(MARKER):
            text, refs = MARKER + text, [0 if self.prefix_ref == "text" else first, *refs]
        return text, refs

    def normalized_text(self, text: str) -> str:
        """The text of ``normalized``, without positions."""
        text = _DROPPED.sub("", _SPACE.sub(" ", text))
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        if self.lowercase:
            text = lower(text)
        text = _SPACE.sub(MARKER, text)
        return text if text.startswith(MARKER) else MARKER + text

    def parts(self, text: str | None) -> list[tuple[str, bool]]:
        """Special tokens as they are (True), and the normalized text between them."""
        if text is None or not text.strip():
            return []
        specials = self.vocab.special_tokens()
        if not any(t in text for t in specials):
            return [(self.normalized_text(text), False)]
        found = split_special(text, [0] * len(text), specials, self.vocab.specials.unk)
        return [(p.text, True) if p.mask != Mask.NONE else (self.normalized_text(p.text), False) for p in found]

    def _path_ids(self, text: str, path: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path's tokens, runs of unknown nodes being one."""
        out = []
        for unknown, run in groupby(path, key=lambda node: node[2] == 0):
            run = list(run)
            cuts = [(run[0][0], run[-1][1])] if unknown else [(a, b) for a, b, _ in run]
            out += [self.vocab.token_to_id(text[a:b]) for a, b in cuts]
        return out

    def tokenize(self, text: str | None) -> list[Token]:
        if text is None or not text.strip():
            return []
        out = []
        for part in split_special(text, list(range(len(text))), self.vocab.special_tokens(), self.vocab.specials.unk):
            if part.mask != Mask.NONE:
                out.append(part)
                continue
            norm, refs = self.normalized(part.text, part.refs)
            path = self.pieces.best_path(norm)
            nodes = [Token(norm[a:b], refs[a:b]) for a, b, _ in path]
            out += populate_masks(merge_unknown(nodes, [i == 0 for _, _, i in path]))
        return out

    def ids(self, text: str | None) -> list[int]:
        """The ids of ``tokenize``."""
        return self.batch_ids([text])[0].tolist()

    def word_ids(self, text: str | None) -> list[int]:
        """ids with each marked word segmented alone. Needs ``Pieces.closed``; equal to ids as long as sums are exact."""
        return self.batch_ids([text], by_word=True)[0].tolist()

    def batch_ids(self, texts: list[str | None], by_word: bool = False) -> list[np.ndarray]:
        """Ids of each text. Words are segmented alone where that cannot change the path, with by_word everywhere."""
        parts = [self.parts(t) for t in texts]
        if self._limit is None:
            self._limit = self.pieces.exact_below() if self.pieces.closed(self.vocab.special_values) else 0.0
            self._highest = max((abs(hit[0]) for hit in self.pieces.table.values() if hit), default=0.0)
        alone = by_word or self._limit > 0
        split = [[None if special or not alone else part[1:].split(MARKER) for part, special in own] for own in parts]
        self._learn({w for own in split for words in own if words for w in words})
        known, empty = self._words, np.zeros(0, dtype=np.int64)
        out = []
        for own, cut in zip(parts, split):
            made = []
            for (part, special), words in zip(own, cut):
                if special:
                    made.append(np.array([self.vocab.token_to_id(part)]))
                    continue
                if words:
                    found = [known[w] for w in words]
                    reach = sum(x for _, x in found) + (1 + max(map(len, words))) * self._highest
                    if by_word or reach < self._limit:
                        made.append(np.frombuffer(b"".join([x for x, _ in found]), dtype=np.int64))
                        continue
                made.append(np.array(self._path_ids(part, self.pieces.best_path(part)), dtype=np.int64))
            out.append(np.concatenate(made) if made else empty)
        return out

    def _learn(self, words: set[str]) -> None:
        """Remembers the ids of words, as bytes, and the absolute sums of their paths."""
        new = [w for w in words if w not in self._words]
        if len(self._words) + len(new) > WORDS:
            self._words.clear()
            new = list(words)
        if not new:
            return
        marked = [MARKER + w for w in new]
        edges, starts, ends, index, sums = self.pieces.lattice.paths(marked)
        if self._ids is None:
            size = 1 + max((hit[1] for hit in self.pieces.table.values() if hit), default=0)
            self._ids = np.zeros(size, dtype=np.int64)
            for t, hit in self.pieces.table.items():
                if hit:
                    self._ids[hit[1]] = self.vocab.token_to_id(t)
        blob, edge, reach = self._ids[index].tobytes(), edges.tolist(), np.abs(sums).tolist()
        self._words.update((w, (blob[8 * a : 8 * b], x)) for w, a, b, x in zip(new, edge, edge[1:], reach))
        unknown = np.unique(np.searchsorted(edges, np.flatnonzero(index == 0), side="right") - 1)
        for i in unknown.tolist():
            path = list(zip(starts[edge[i] : edge[i + 1]].tolist(), ends[edge[i] : edge[i + 1]].tolist(), index[edge[i] : edge[i + 1]].tolist()))
            self._words[new[i]] = (np.array(self._path_ids(marked[i], path), dtype=np.int64).tobytes(), reach[i])


def offset(refs: list[int]) -> dict | None:
    return {"begin": refs[0], "end": refs[-1] + 1} if refs else None
