"""Tokenization of text columns, in Arrow batches with the tokenizer in a broadcast.

The functions work through a batch in slices of about ``SLICE`` bytes of text, whatever the session's batch size, so what they hold
is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..protocols import TokenizerProtocol
from ..schema import TOKEN_IDS, TOKENS
from . import kernel

SLICE = 4 << 20
_OFFSET = pa.struct([("begin", pa.int32()), ("end", pa.int32())])


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[list[str | None]]:
    """The texts in lists of about most bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += t.as_buffer().size if t.is_valid else 0
        if size >= most:
            yield texts[at : i + 1].to_pylist()
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:].to_pylist()


def lists(found: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays of numbers as one Arrow array of lists."""
    edges = np.cumsum([0, *map(len, found)], dtype=np.int64)
    flat = np.concatenate([*found, np.zeros(0, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat, kind))


def tokens_column(spark: SparkSession, tokenizer: TokenizerProtocol):
    """A function of a text column: STRUCT of tokens, offsets, refs and masks."""
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.arrow_udf(TOKENS)
    def tokenize(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for part in slices(batch):
                yield _rows([shared.value.tokenize(t) for t in part], "tokens", pa.string(), lambda t: t.text)
            if not len(batch):
                yield _rows([], "tokens", pa.string(), None)

    return tokenize


def token_ids_column(spark: SparkSession, tokenizer: TokenizerProtocol):
    """A function of a text column: STRUCT of ids, offsets, refs and masks."""
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.arrow_udf(TOKEN_IDS)
    def tokenize(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            one = shared.value
            for part in slices(batch):
                yield _rows([one.tokenize(t) for t in part], "ids", pa.int64(), lambda t: one.vocab.token_to_id(t.text))
            if not len(batch):
                yield _rows([], "ids", pa.int64(), None)

    return tokenize


def ids_column(spark: SparkSession, tokenizer: TokenizerProtocol, mode: str = "exact"):
    """A function of a text column: the ids only. mode "word" segments distinct words once; it needs a closed set of pieces."""
    if mode not in ("exact", "word"):
        raise ValueError(f"mode {mode!r}")
    if mode == "word" and isinstance(tokenizer, kernel.Tokenizer) and not tokenizer.pieces.closed(tokenizer.vocab.special_values):
        raise ValueError("word mode needs markers in front only and every character of a piece as a piece")
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.arrow_udf("array<bigint>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for part in slices(batch):
                yield lists(shared.value.batch_ids(part, by_word=mode == "word"), pa.int64())
            if not len(batch):
                yield lists([], pa.int64())

    return ids


def _rows(found: list[list[kernel.Token]], name: str, kind: pa.DataType, value) -> pa.StructArray:
    flat = [t for one in found for t in one]
    edges = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
    refs = lists([np.array(t.refs, dtype=np.int64) for t in flat], pa.int32())
    none = np.array([not t.refs for t in flat], dtype=bool)
    ends = [pa.array([f(t.refs) if t.refs else 0 for t in flat], pa.int32()) for f in (lambda r: r[0], lambda r: r[-1] + 1)]
    offsets = pa.StructArray.from_arrays(ends, fields=list(_OFFSET), mask=pa.array(none, pa.bool_()))
    columns = {name: pa.array([value(t) for t in flat], kind), "offsets": offsets, "refs": refs, "masks": pa.array([int(t.mask) for t in flat], pa.int8())}
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(edges, c) for c in columns.values()], names=list(columns))


def tokenize(df: DataFrame, tokenizer: TokenizerProtocol, text: str = "text", out: str = "tokenized") -> DataFrame:
    """df with the tokens of each text; null and blank texts have none."""
    return df.withColumn(out, tokens_column(df.sparkSession, tokenizer)(F.col(text)))


def explode_tokens(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Long form: keys, pos, token (or id), begin, end, mask."""
    kind = "tokens" if "tokens:" in df.schema[column].dataType.simpleString() else "ids"
    name = kind[:-1]
    each = df.select(*keys, F.posexplode(F.arrays_zip(*[F.col(f"{column}.{c}").alias(c) for c in (kind, "offsets", "masks")])).alias("pos", "x"))
    return each.select(*keys, "pos", F.col(f"x.{kind}").alias(name), F.col("x.offsets.begin").alias("begin"), F.col("x.offsets.end").alias("end"), F.col("x.masks").cast("int").alias("mask"))


def mask_name(mask: Column) -> Column:
    names = ["none", "whitespace", "punctuation", "cjk", "special", "begin", "continuation", "unfinished", "unknown"]
    return F.get(F.array(*map(F.lit, names)), mask)
