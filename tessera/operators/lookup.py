"""Vocabulary look-ups: tokens to ids and ids to tokens as joins, arrays in place, and vocabularies that grow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..protocols import VocabProtocol

#: Vocabularies of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(vocab: DataFrame) -> DataFrame:
    """vocab, to be broadcast if its size, which is checked here, allows it."""
    small = vocab.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(vocab) if small else vocab


def token_to_id(rows: DataFrame, vocab: DataFrame, unk_id: int, token: str = "token", out: str = "id") -> DataFrame:
    """rows with the id of each token; missing ones get unk_id."""
    v = checked_broadcast(vocab.select(F.col("token").alias("__token"), F.col("id").alias("__id")))
    return rows.join(v, F.col(token) == F.col("__token"), "left").withColumn(out, F.coalesce("__id", F.lit(unk_id).cast("long"))).drop("__token", "__id")


def id_to_token(rows: DataFrame, vocab: DataFrame, unk: str, ident: str = "id", out: str = "token") -> DataFrame:
    """rows with the token of each id; missing ones get the unknown token."""
    v = checked_broadcast(vocab.select(F.col("id").alias("__id"), F.col("token").alias("__token")))
    return rows.join(v, F.col(ident) == F.col("__id"), "left").withColumn(out, F.coalesce("__token", F.lit(unk))).drop("__token", "__id")


def array_to_ids(rows: DataFrame, vocab: VocabProtocol, tokens: str = "tokens", out: str = "ids") -> DataFrame:
    """rows with the ids of an array of tokens, in order and in place; null and empty arrays give empty arrays, null tokens the unknown id."""
    known = {**vocab.values, **vocab.special_values}
    shared = rows.sparkSession.sparkContext.broadcast((list(known), np.array([*known.values(), vocab.token_to_id(vocab.specials.unk)], dtype=np.int64)))

    @F.arrow_udf("array<bigint>")
    def ids(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, numbers = shared.value
        names = pa.array(names, pa.string())
        for batch in column:
            at = pc.index_in(batch.flatten().cast(pa.string()), value_set=names).fill_null(-1).to_numpy()
            edges = np.cumsum([0, *batch.value_lengths().fill_null(0).to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(numbers[at], pa.int64()))

    return rows.withColumn(out, ids(F.col(tokens)))


def special_tokens(vocab: DataFrame) -> DataFrame:
    return vocab.where("is_special").select("token", "id")


def add_tokens(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """vocab and those tokens (token, ord) that are missing, with the next ids in the order of ord; first ones of duplicates count.

    The added tokens are numbered in one task: they are a vocabulary's increment, not a corpus.
    """
    new = tokens.groupBy("token").agg(F.min("ord").alias("ord")).join(vocab.select("token"), "token", "left_anti")
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = new.withColumn("k", F.row_number().over(Window.orderBy("ord"))).join(F.broadcast(last))
    return vocab.select("id", "token", "is_special").unionByName(numbered.select((F.col("last") + F.col("k")).alias("id"), "token", F.lit(False).alias("is_special")))


def add_extra_ids(vocab: DataFrame, n: int) -> DataFrame:
    """vocab and n sentinel tokens after its last id."""
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    extra = vocab.sparkSession.range(n).join(F.broadcast(last))
    return vocab.select("id", "token", "is_special").unionByName(
        extra.select((F.col("last") + 1 + F.col("id")).alias("id"), F.concat(F.lit("<extra_id_"), F.col("id").cast("string"), F.lit(">")).alias("token"), F.lit(False).alias("is_special"))
    )


def ids_literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])
