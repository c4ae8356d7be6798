"""What the engine asks of vocabularies and tokenizers; any object with these members can take their place."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol, runtime_checkable

import numpy as np


@runtime_checkable
class VocabProtocol(Protocol):
    """Tokens and ids, and the special ones among them."""

    values: dict[str, int]
    indices: dict[int, str]
    special_values: dict[str, int]
    special_indices: dict[int, str]

    def special_tokens(self) -> list[str]: ...

    def default(self, name: str) -> str | None:
        """A special token by its role: unk, pad, bos, sep, cls, eos or mask."""
        ...

    def token_to_id(self, token: str) -> int: ...

    def id_to_token(self, i: int) -> str: ...

    def tokens_to_ids(self, tokens: Iterable[str]) -> list[int]: ...

    def add_tokens(self, tokens: Iterable[str]) -> None: ...

    def add_extra_ids(self, n: int) -> None: ...


@runtime_checkable
class TokenizerProtocol(Protocol):
    """Texts to tokens and ids over a vocabulary; what ``encode``, ``tokens_column`` and ``ids_column`` take."""

    vocab: VocabProtocol
    paired: bool

    def tokenize(self, text: str | None) -> list:
        """Tokens with texts, positions and masks."""
        ...

    def ids(self, text: str | None) -> list[int]: ...

    def batch_ids(self, texts: list[str | None], by_word: bool = False) -> list[np.ndarray]: ...
