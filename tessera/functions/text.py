"""Cleaning and normalization of text columns. Null stays null unless a function says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .charclass import BLANK_CLASS, CONTROL_CLASS, CONTROL_LAX_CLASS, DROPPED_CLASS, MARKER, PLAIN_CLASS, WHITESPACE

#: Replacements that tidy decoded text, in order.
CLEANUP = (
    (" .", "."), (" !", "!"), (" ?", "?"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"),
    (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
)

def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(text, F.lit("")).rlike(f"^{BLANK_CLASS}*$")


SPACES = "".join(map(chr, WHITESPACE))


def odd_ones(text: Column) -> Column:
    """The characters of a text that may be white space or controls: what is plain goes, in long runs."""
    return F.regexp_replace(text, f"{PLAIN_CLASS}++", "")


def count_whitespace(text: Column) -> Column:
    odd = odd_ones(text)
    return F.length(odd) - F.length(F.translate(odd, SPACES, ""))


def count_control(text: Column, strict: bool = True) -> Column:
    """Strict ones are those that cleaning deletes, U+FFFD apart."""
    odd = odd_ones(text)
    return F.length(odd) - F.length(F.regexp_replace(odd, CONTROL_CLASS if strict else CONTROL_LAX_CLASS, ""))


def clean_text(text: Column) -> Column:
    """White space becomes a space; controls, NUL and U+FFFD go, if there are any."""
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.when(odd_ones(text).rlike(DROPPED_CLASS), F.regexp_replace(spaced, DROPPED_CLASS, "")).otherwise(spaced)


def whitespace_to_marker(text: Column) -> Column:
    return F.translate(text, SPACES, MARKER * len(SPACES))


def dummy_prefix(text: Column) -> Column:
    return F.when(text.startswith(MARKER), text).otherwise(F.concat(F.lit(MARKER), text))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def _beyond_ascii(function) -> Callable[[Column], Column]:
    """A function of a text column from one of texts that leaves ASCII alone; batches of ASCII texts pass through as they are."""

    @F.arrow_udf(StringType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            plain = pc.string_is_ascii(batch).fill_null(True)
            if pc.all(plain).as_py() is not False:
                yield batch
                continue
            changed = pa.array([function(t) for t in batch.filter(pc.invert(plain)).to_pylist()], batch.type)
            yield pc.replace_with_mask(batch, pc.invert(plain), changed)

    return run


def _without_accents(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


_nfkc = _beyond_ascii(lambda t: unicodedata.normalize("NFKC", t))
_strip = _beyond_ascii(_without_accents)


def nfkc(text: Column) -> Column:
    return _nfkc(text)


def strip_accents(text: Column) -> Column:
    return _strip(text)


def clean_word(text: Column) -> Column:
    """The pre-tokenizer's cleaning: category C goes, double back-quotes and apostrophes become a quote."""
    return F.replace(F.replace(F.regexp_replace(text, r"\p{C}+", ""), F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"'))


def clean_up_tokenization(text: Column) -> Column:
    for old, new in CLEANUP:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def substring_chars(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Code points from start (0-based)."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(text, start + 1, F.length(text) if length is None else F.lit(length) if isinstance(length, int) else length)


def substring_bytes(text: Column, start: Column | int, end: Column | int | None = None) -> Column:
    """The UTF-8 bytes [start, end) as text; a cut inside a character gives replacement characters."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.octet_length(text) if end is None else F.lit(end) if isinstance(end, int) else end
    raw = F.substring(F.encode(text, "UTF-8"), start + 1, F.greatest(end - start, F.lit(0)))
    return F.make_valid_utf8(raw.cast("string"))


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


@F.pandas_udf(ArrayType(IntegerType()))
def running_sum(s: pd.Series) -> pd.Series:
    """Running sums of arrays of numbers; an expression could only build them in quadratic time."""
    return s.map(lambda x: None if x is None else np.cumsum(x))


@F.pandas_udf(ArrayType(IntegerType()))
def _byte_starts(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else np.flatnonzero((np.frombuffer(t.encode(), np.uint8) & 0xC0) != 0x80).astype(np.int32))


def char_byte_offsets(text: Column) -> Column:
    """array<struct<index, char>>: the UTF-8 byte offset of each code point."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.arrays_zip(_byte_starts(text).alias("index"), chars.alias("char"))


@F.pandas_udf(IntegerType())
def grapheme_count(s: pd.Series) -> pd.Series:
    """Extended grapheme clusters."""
    import regex

    return s.map(lambda t: None if t is None else len(regex.findall(r"\X", t))).astype("Int32")
