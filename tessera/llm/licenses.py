"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, and a shunting-yard
parser reads the license expressions behind the tags.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters; phrases match whole
consecutive words. An expression is the longest valid one that follows ``SPDX-License-Identifier:`` on its line, up to the end of a
comment; AND binds closer than OR, WITH closer than AND. Where nothing valid follows, the tag still counts. Each expression is evaluated:
it is permitted if a choice among its alternatives needs licences of the ``PERMISSIVE`` families only; the text's verdict is whether all
its expressions are, null without any.

Null texts are empty: no words, no places, empty labels, score 0. Rows are scanned one by one and whole, so
repeated rows and null ids change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases; they add labels but no base places.
MORE = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "cc by": "cc",
    "cc0": "cc",
    "all rights reserved": "proprietary",
}
#: Words that announce a notice; a place near one weighs more.
NOTICES = ("licensed under", "released under", "distributed under", "under the terms of")
TAG = "spdx license identifier"
#: Prefix of an identifier -> label; the first that fits.
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("0bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"), ("isc", "isc"), ("bsl", "bsl"), ("cc", "cc"))
#: Families that an evaluated expression may need.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "bsl", "cc"})
WEIGHTS = {"tag": 0.95, "notice": 0.85, "phrase": 0.6}

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-:]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """The longest valid expression at the start, in postfix order (operators in lower case), or None if there is none."""
    out, stack, operand, best = [], [], True, None
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand:
                break
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif low in _RANK:
            if operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
        if not operand and "(" not in stack:
            best = out + stack[::-1]
    return best


def evaluate(postfix: list[str], allowed) -> bool:
    """Whether allowed(identifier) satisfies the expression; an exception added by WITH changes nothing."""
    stack = []
    for token in postfix:
        if token not in _RANK:
            stack.append((token, allowed(token)))
            continue
        right, left = stack.pop(), stack.pop()
        value = left[1] if token == "with" else left[1] and right[1] if token == "and" else left[1] or right[1]
        stack.append(("", value))
    return stack[0][1]


def identifiers(postfix: list[str]) -> list[str]:
    """The license identifiers of a parsed expression, without the exceptions that WITH adds."""
    stack, found = [], []
    for token in postfix:
        if token not in _RANK:
            stack.append([token])
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left + right)
    for x in stack[0]:
        if x not in found:
            found.append(x)
    return found


def family(identifier: str) -> str | None:
    low = identifier.lower()
    return next((label for start, label in FAMILIES if low.startswith(start)), None)


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("more", MORE), ("notice", NOTICES), ("tag", [TAG])):
        for p in phrases:
            found.add_word(f" {p} ", (kind, p))
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[str], bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permitted of one text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.translate(_LOWER).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, doubts, notices, tagged, seen, at = [], set(), set(), 1.0, [], False, 0, 0
    hits = sorted((end - len(p) - 1, kind, p) for end, (kind, p) in automaton().iter(joined))
    notices = [start for start, kind, _ in hits if kind == "notice"]
    last_notice = 0
    for start, kind, p in hits:
        if kind == "tag":
            tagged = True
        elif kind in ("base", "more"):
            if kind == "base":
                seen, at = seen + joined.count(" ", at, start), start
                starts.append(seen)
                base.add(BASE[p])
            labels.add(BASE.get(p) or MORE[p])
            while last_notice + 1 < len(notices) and notices[last_notice + 1] <= start:
                last_notice += 1
            near = bool(notices) and 0 <= start - notices[last_notice] <= 80
            doubts *= 1 - WEIGHTS["notice" if near else "phrase"]
    expressions, permitted = [], None
    if tagged:
        doubts *= 1 - WEIGHTS["tag"]
        for m in re.finditer(rb"(?i)spdx-license-identifier:([^\n]*)", raw):
            postfix = parse(re.split(r"\*/|-->", m[1].decode("utf-8", "replace"), maxsplit=1)[0])
            if postfix:
                permitted = evaluate(postfix, lambda x: family(x) in PERMISSIVE) and permitted is not False
                expressions.append(" ".join(postfix))
                labels.update(filter(None, map(family, identifiers(postfix))))
    return (
        len(words),
        len(starts),
        starts[0] if starts else None,
        starts[-1] if starts else None,
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        0.0 if doubts == 1.0 else 1.0 - doubts,
        expressions,
        permitted,
    )


COLUMNS = (
    ("n_words", pa.int64(), "long"),
    ("n_base", pa.int64(), "long"),
    ("first_word", pa.int64(), "long"),
    ("last_word", pa.int64(), "long"),
    ("base_labels", pa.string(), "string"),
    ("labels", pa.string(), "string"),
    ("score", pa.float64(), "double"),
    ("expressions", pa.list_(pa.string()), "array<string>"),
    ("permitted", pa.bool_(), "boolean"),
)


def licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs in the struct ``row``, and the columns of ``scan``; expressions are in postfix order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(scan, b.column(1).to_pylist()))) or [()] * len(COLUMNS)
            made = [pa.array(c, t) for c, (_, t, _) in zip(cols, COLUMNS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", *[n for n, _, _ in COLUMNS]])

    short_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, _, t in COLUMNS))


def query(docs: DataFrame) -> DataFrame:
    return licenses(docs.select("doc_id", "text")).select("row.doc_id", *[n for n, _, _ in COLUMNS[:-2]], F.array_join("expressions", "; ").alias("expressions"), "permitted")
