"""Vocabularies: special tokens, token <-> id maps, and their readers.

A vocabulary is loaded once on the driver; the engine ships it as a DataFrame for joins (``frame``) or inside
a function (``ids``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import TokenizerFileNotFound, TokenNotFound, VocabularyParsingError
from .protowire import Piece, read_model


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8-sig") as f:
            return f.read()
    except FileNotFoundError:
        raise TokenizerFileNotFound(path) from None


def _indexed(tokens: Iterable[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, t in enumerate(tokens):
        if t in out:
            raise VocabularyParsingError(f"duplicate token {t!r}")
        out[t] = i
    return out


def invert(values: dict[str, int]) -> dict[int, str]:
    out = {i: t for t, i in values.items()}
    if len(out) != len(values):
        raise VocabularyParsingError("two tokens share an id")
    return out


@dataclass
class SpecialTokens:
    """The special tokens of a vocabulary; the order of the fields is the order of registration."""

    unk: str = "[UNK]"
    pad: str | None = None
    bos: str | None = None
    sep: str | None = None
    cls: str | None = None
    eos: str | None = None
    mask: str | None = None
    additional: list[str] = field(default_factory=list)

    def in_order(self) -> list[str]:
        found = [self.unk, self.pad, self.bos, self.sep, self.cls, self.eos, self.mask, *self.additional]
        return list(dict.fromkeys(t for t in found if t))

    @classmethod
    def from_json(cls, path: str) -> SpecialTokens:
        """Keys like UnkToken or unk_token; other keys are ignored."""
        raw = json.loads(_read(path))
        out = cls()
        for name in ("unk", "pad", "bos", "sep", "cls", "eos", "mask"):
            value = raw.get(f"{name.capitalize()}Token", raw.get(f"{name}_token"))
            if value:
                setattr(out, name, value)
        out.additional = list(raw.get("AdditionalSpecialTokens") or raw.get("additional_special_tokens") or [])
        return out


class Vocab:
    """Tokens and ids. Special tokens are found first; a token that is missing has the id of ``specials.unk``."""

    def __init__(self, values: dict[str, int], specials: SpecialTokens):
        if values is None or specials is None:
            raise ValueError("a vocabulary needs values and special tokens")
        self.values = dict(values)
        self.specials = specials
        self.special_values: dict[str, int] = {}
        for token in specials.in_order():
            if token not in self.values:
                raise TokenNotFound(f"Unknown token {token} not found")
            self.special_values[token] = self.values[token]
        self.indices = invert(self.values)
        self.special_indices = invert(self.special_values)

    # readers

    @classmethod
    def from_flat_file(cls, path: str, specials: SpecialTokens | None = None) -> Vocab:
        """One token a line; the id is the line's number."""
        lines = _read(path).split("\n")
        if lines and not lines[-1]:
            lines.pop()
        return cls(_indexed(x.strip() for x in lines), specials or SpecialTokens())

    @classmethod
    def from_json(cls, path: str, specials: SpecialTokens | None = None) -> Vocab:
        """One object of token: id."""
        return cls({str(k): int(v) for k, v in json.loads(_read(path)).items()}, specials or SpecialTokens())

    @classmethod
    def from_pieces(cls, pieces: list[Piece]) -> Vocab:
        """Piece -> position."""
        return cls(_indexed(p.text for p in pieces), SpecialTokens(unk="<unk>"))

    @classmethod
    def from_sentencepiece(cls, path: str, specials: SpecialTokens | None = None) -> Vocab:
        """The pair-template layout: classifier, padding, end, unknown; then all pieces but the first three; then the mask."""
        return cls.pair_layout(read_model(path).pieces, specials)

    @classmethod
    def pair_layout(cls, pieces: list[Piece], specials: SpecialTokens | None = None) -> Vocab:
        known = specials or SpecialTokens(unk="<unk>", pad="<pad>", bos="<s>", sep="</s>", cls="<s>", eos="</s>", mask="<mask>")
        values: dict[str, int] = {}

        def add(token: str | None) -> None:
            if token and token not in values:
                values[token] = len(values)

        for token in (known.cls, known.pad, known.eos, known.unk):
            add(token)
        for p in pieces[3:]:
            if p.text in values:
                raise VocabularyParsingError(f"duplicate token {p.text!r}")
            add(p.text)
        add(known.mask)
        return cls(values, known)

    # look-up

    @property
    def unk_id(self) -> int:
        return self.special_values[self.specials.unk]

    def token_to_id(self, token: str) -> int:
        found = self.special_values.get(token)
        return found if found is not None else self.values.get(token, self.unk_id)

    def id_to_token(self, i: int) -> str:
        found = self.special_indices.get(i)
        return found if found is not None else self.indices.get(i, self.specials.unk)

    def tokens_to_ids(self, tokens: Iterable[str]) -> list[int]:
        return [self.token_to_id(t) for t in tokens]

    def special_tokens(self) -> list[str]:
        return list(self.special_values)

    def default(self, name: str) -> str | None:
        """A special token by its role, or its usual form where none is set; the unknown token has none."""
        usual = {"pad": "<pad>", "bos": "<s>", "sep": "</s>", "cls": "<s>", "eos": "</s>", "mask": "<mask>"}
        return getattr(self.specials, name) or usual.get(name)

    # growth

    def add_tokens(self, tokens: Iterable[str]) -> None:
        """Tokens that are missing get the next ids; they are not special. The first id of an empty vocabulary is 1."""
        last = max(self.values.values(), default=0)
        for t in tokens:
            if t not in self.values:
                last += 1
                self.values[t] = last
                self.indices[last] = t

    def add_extra_ids(self, n: int) -> None:
        """Appends <extra_id_0> ... ; one that was there gets a new id, and its old id still reads as it."""
        last = max(self.values.values(), default=0)
        for k in range(n):
            self.values[f"<extra_id_{k}>"] = last + 1 + k
            self.indices[last + 1 + k] = f"<extra_id_{k}>"

    def frame(self, spark: SparkSession) -> DataFrame:
        """(id, token, is_special)."""
        rows = [(i, t, t in self.special_values) for t, i in self.values.items()]
        return spark.createDataFrame(rows, "id bigint, token string, is_special boolean")
