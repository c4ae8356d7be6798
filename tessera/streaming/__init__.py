"""The engine on streams. Encoding has no state, so it runs on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode as _encode
from ..operators.kernel import Tokenizer
from ..operators.tokenize import tokens_column


def encode(stream: DataFrame, tokenizer: Tokenizer, text: str = "text", **options) -> DataFrame:
    """A stream with the encoding of each text; options are those of the batch operator."""
    return _encode.encode(stream, tokenizer, text, **options)


def token_counts(stream: DataFrame, tokenizer: Tokenizer, text: str, time: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of tokens per window of event time; rows later than delay are left out and their state is dropped."""
    tokens = stream.withWatermark(time, delay).select(time, F.explode(tokens_column(stream.sparkSession, tokenizer)(F.col(text))["tokens"]).alias("token"))
    return tokens.groupBy(F.window(time, window).alias("w"), "token").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "token", "n")


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Writes a stream as Parquet with exactly-once files."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
