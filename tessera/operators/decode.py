"""Decoding: ids to tokens in place, tokens to text by expressions; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charclass import MARKER
from ..functions.text import clean_up_tokenization
from ..protocols import VocabProtocol


def tokens_of_ids(spark: SparkSession, vocab: VocabProtocol, skip_special: bool = False):
    """A function of a column of arrays of ids: the arrays of their tokens, the unknown token for ids that are missing; null gives an empty array.

    The vocabulary is shipped once as sorted ids with their tokens.
    """
    found = {**vocab.indices, **vocab.special_indices}
    shared = spark.sparkContext.broadcast((np.array(sorted(found), dtype=np.int64), [*(found[i] for i in sorted(found)), vocab.specials.unk], np.array(sorted(vocab.special_indices), dtype=np.int64)))

    @F.arrow_udf("array<string>")
    def tokens(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, texts, special = shared.value
        names = pa.array(texts, pa.string())
        for batch in ids:
            flat = batch.flatten()
            edges = np.cumsum([0, *batch.value_lengths().fill_null(0).to_pylist()])
            at, missing = flat.fill_null(-1).to_numpy().astype(np.int64), np.array(flat.is_null())
            if skip_special:
                kept = ~np.isin(at, special) | missing
                edges = np.concatenate([[0], np.cumsum(kept)])[edges]
                at = at[kept]
            place = np.minimum(np.searchsorted(known, at), max(len(known) - 1, 0))
            place = np.where(known[place] == at, place, len(known)) if len(known) else np.zeros(len(at), dtype=np.int64)
            yield pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), names.take(pa.array(place)))

    return tokens


def ids_to_tokens(rows: DataFrame, vocab: VocabProtocol, ids: str = "ids", out: str = "tokens", skip_special: bool = False) -> DataFrame:
    """rows with the tokens of an array of ids; special ids can be left out."""
    return rows.withColumn(out, tokens_of_ids(rows.sparkSession, vocab, skip_special)(F.col(ids)))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def detokenize(tokens: Column) -> Column:
    """Tokens with markers as text; the space of the first marker stays."""
    return F.translate(F.array_join(tokens, ""), MARKER, " ")


def decode(rows: DataFrame, vocab: VocabProtocol, ids: str = "ids", out: str = "text", skip_special: bool = False, clean_up: bool = False) -> DataFrame:
    """rows with the text of an array of ids: tokens joined by spaces, tidied if asked."""
    text = join_tokens(tokens_of_ids(rows.sparkSession, vocab, skip_special)(F.col(ids)))
    return rows.withColumn(out, clean_up_tokenization(text) if clean_up else text)
