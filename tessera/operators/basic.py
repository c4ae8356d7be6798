"""The pre-tokenizer as a tokenizer: words, special tokens, punctuation and letters without case, with positions and ids.

White space (space, tab, line breaks) separates words; special tokens inside a word are cut out; each punctuation character and
each letter without case (category Lo) is a token, so is each run of others; then tokens are cleaned, lower-cased and
stripped of accents as asked, and empty ones go. Cutting by punctuation does not spare special tokens, and of the masks
only that of letters without case is left. Positions are code points of the input, of the token before cleaning.

What a word becomes depends on nothing around it, so a worker remembers words. The expressions of ``pretokenize`` give the same texts and masks
without ids and positions.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np

from ..schema import Mask
from ..sources.vocab import SpecialTokens, Vocab
from .kernel import WORDS, Token, split_special

_BETWEEN = str.maketrans("\t\n\r", "   ")


def without_accents(text: str) -> str:
    """text without non-spacing marks, composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def cuts(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, mask) of a text's tokens: punctuation, letters without case, and runs of others."""
    out: list[tuple[int, int, int]] = []
    open_at = None
    for i, c in enumerate(text):
        kind = unicodedata.category(c)
        if kind[0] != "P" and kind != "Lo":
            open_at = i if open_at is None else open_at
            continue
        if open_at is not None:
            out.append((open_at, i, Mask.NONE))
            open_at = None
        out.append((i, i + 1, Mask.CJK if kind == "Lo" else Mask.NONE))
    return out if open_at is None else [*out, (open_at, len(text), Mask.NONE)]


@dataclass
class BasicTokenizer:
    """A vocabulary over words; picklable, shipped to workers in a broadcast. ``encode`` puts no template around its sequences unless given one."""

    vocab: Vocab
    lowercase: bool = False
    strip_accents: bool = False
    paired: bool = False
    _words: dict[str, tuple[list[tuple[str, int, int, int]], bytes]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": {}}

    @classmethod
    def from_file(cls, path: str, lowercase: bool = False, strip_accents: bool = False, specials: str | None = None) -> BasicTokenizer:
        """From a flat vocabulary file and, if given, a file that maps special tokens."""
        known = SpecialTokens.from_json(specials) if specials else None
        return cls(Vocab.from_flat_file(path, known), lowercase, strip_accents)

    def clean(self, token: str) -> str:
        """Category C goes, double back-quotes and apostrophes become a quote; then case and accents."""
        token = "".join(c for c in token if unicodedata.category(c)[0] != "C") if not (token.isascii() and token.isprintable()) else token
        token = token.replace("``", '"').replace("''", '"')
        token = token.lower() if self.lowercase else token
        return without_accents(token) if self.strip_accents else token

    def _word(self, word: str) -> tuple[list[tuple[str, int, int, int]], bytes]:
        """(text, begin, end, mask) of a word's tokens, and their ids as bytes."""
        found = self._words.get(word)
        if found is None:
            tokens = []
            for part in split_special(word, list(range(len(word))), self.vocab.special_tokens(), self.vocab.specials.unk):
                for a, b, mask in cuts(part.text):
                    text = self.clean(part.text[a:b])
                    if text:
                        tokens.append((text, part.refs[a], part.refs[b - 1] + 1, mask))
            if len(self._words) >= WORDS:
                self._words.clear()
            found = self._words[word] = tokens, np.array([self.vocab.token_to_id(t) for t, *_ in tokens], dtype=np.int64).tobytes()
        return found

    def tokenize(self, text: str | None) -> list[Token]:
        out, at = [], 0
        for word in (text or "").translate(_BETWEEN).split(" "):
            if word:
                out += [Token(t, list(range(at + a, at + b)), mask) for t, a, b, mask in self._word(word)[0]]
            at += len(word) + 1
        return out

    def ids(self, text: str | None) -> list[int]:
        return self.batch_ids([text])[0].tolist()

    def batch_ids(self, texts: list[str | None], by_word: bool = False) -> list[np.ndarray]:
        """Ids of each text; words are always segmented alone."""
        return [np.frombuffer(b"".join([self._word(w)[1] for w in (t or "").translate(_BETWEEN).split(" ") if w]), dtype=np.int64) for t in texts]
