"""Types of the engine's results."""

from __future__ import annotations

from enum import Enum, IntEnum

OFFSET = "struct<begin:int,end:int>"
TOKENS = f"struct<tokens:array<string>,offsets:array<{OFFSET}>,refs:array<array<int>>,masks:array<tinyint>>"
TOKEN_IDS = f"struct<ids:array<bigint>,offsets:array<{OFFSET}>,refs:array<array<int>>,masks:array<tinyint>>"
ENCODED = (
    "struct<token_ids:array<bigint>,segment_ids:array<tinyint>,special_tokens_mask:array<tinyint>,overflowing_tokens:array<bigint>,"
    f"num_truncated_tokens:int,token_offsets:array<{OFFSET}>,reference_offsets:array<array<int>>,masks:array<tinyint>,error:string>"
)


class Mask(IntEnum):
    NONE = 0
    WHITESPACE = 1
    PUNCTUATION = 2
    CJK = 3
    SPECIAL = 4
    BEGIN = 5
    CONTINUATION = 6
    UNFINISHED = 7
    UNKNOWN = 8


class Truncation(str, Enum):
    LONGEST_FIRST = "longest_first"
    ONLY_FIRST = "only_first"
    ONLY_SECOND = "only_second"
    DO_NOT_TRUNCATE = "do_not_truncate"
