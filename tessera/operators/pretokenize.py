"""Splitting of text columns into tokens by white space, punctuation, letters without case, and special tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.charclass import BLANK_CLASS
from ..functions.text import clean_word, running_sum, strip_accents
from ..schema import Mask

TOKEN = "array<struct<text:string,mask:int>>"


def quote(token: str) -> str:
    """token as a regular expression that Java and RE2 both read."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", token)


def alternation(tokens: list[str]) -> str:
    """Special tokens, the first that fits wins."""
    return "|".join(map(quote, tokens))


def split_special(text: Column, tokens: list[str], unk: str | None = None) -> Column:
    """array of (text, mask): special tokens in place, the text between; what stands before one loses trailing white space."""
    if not tokens:
        return F.array(F.struct(text.alias("text"), F.lit(int(Mask.NONE)).alias("mask")))
    between = F.split(text, alternation(tokens), -1)

    def cut(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            token = F.get(found, i)
            return F.array(
                F.struct(F.when(token.isNull(), x).otherwise(F.regexp_replace(x, f"{BLANK_CLASS}+$", "")).alias("text"), F.lit(int(Mask.NONE)).alias("mask")),
                F.struct(F.coalesce(token, F.lit("")).alias("text"), F.when(token == F.lit(unk), int(Mask.UNKNOWN)).otherwise(int(Mask.SPECIAL)).alias("mask")),
            )

        return F.filter(F.flatten(F.transform(between, one)), lambda x: x["text"] != "")

    # the tokens found are bound to a lambda variable, so that they are looked for once in a text
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({alternation(tokens)})"), F.lit(1))), cut)[0]


def whitespace_split(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t\\n\\r]+"), "")


def punct_split(text: Column) -> Column:
    """Each punctuation character is a token, so is each run of others."""
    return F.regexp_extract_all(text, F.lit(r"(\p{P}|[^\p{P}]+)"), F.lit(1))


def cjk_split(text: Column) -> Column:
    """Each letter without case (category Lo) is a token, so is each run of others."""
    return F.regexp_extract_all(text, F.lit(r"(\p{Lo}|[^\p{Lo}]+)"), F.lit(1))


def basic_tokenize(text: Column, specials: list[str] | None = None, unk: str | None = None, lower: bool = False, strip: bool = False) -> Column:
    """array of (text, mask): white space, special tokens, punctuation, letters without case, then cleaning.

    Splitting by punctuation does not spare special tokens, and only the mask of letters without case is left.
    """
    words = whitespace_split(strip_accents(text) if strip else text)  # accents bear on no split
    parts = F.flatten(F.transform(words, lambda w: F.transform(split_special(w, specials or [], unk), lambda x: x["text"])))
    parts = F.flatten(F.transform(parts, punct_split))
    parts = F.flatten(F.transform(parts, cjk_split))
    lo = F.transform(parts, lambda p: F.struct(clean_word(p).alias("text"), F.when(p.rlike(r"^\p{Lo}$"), int(Mask.CJK)).otherwise(int(Mask.NONE)).alias("mask")))
    if lower:
        lo = F.transform(lo, lambda x: F.struct(F.lower(x["text"]).alias("text"), x["mask"].alias("mask")))
    return F.filter(lo, lambda x: x["text"] != "")


def basic_offsets(text: Column) -> Column:
    """array of (text, begin, end): the same splits without special tokens, with positions in the text."""
    parts = F.regexp_extract_all(text, F.lit(r"([ \t\n\r]+|\p{P}|\p{Lo}|[^ \t\n\r\p{P}\p{Lo}]+)"), F.lit(1))
    ends = running_sum(F.transform(parts, F.length))
    placed = F.transform(F.arrays_zip(parts.alias("text"), ends.alias("end")), lambda x: F.struct(x["text"].alias("text"), (x["end"] - F.length(x["text"])).alias("begin"), x["end"].alias("end")))
    return F.filter(placed, lambda x: ~x["text"].rlike("^[ \t\n\r]"))
