"""Segmentation of distinct words as relational operators: prefix search as a join, best path as a fold or in Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.charclass import MARKER
from . import kernel
from .lookup import checked_broadcast
from .spread import spread


def marked_words(text: Column) -> Column:
    """The words of cleaned text, each with its leading marker: array<string>."""
    marked = F.translate(text, " ", MARKER)
    return F.regexp_extract_all(F.when(marked.startswith(MARKER), marked).otherwise(F.concat(F.lit(MARKER), marked)), F.lit(f"({MARKER}[^{MARKER}]*)"), F.lit(1))


def prefix_search(words: DataFrame, vocab: DataFrame, longest: int, word: str = "word") -> DataFrame:
    """(word, st, en, piece, score, idx): every piece at every place of the distinct words; an equi-join on substrings."""
    n = F.length(word)
    starts = words.select(word, F.explode(F.sequence(F.lit(0), n - 1)).alias("st"))
    spans = starts.select(word, "st", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("st")))).alias("len"))
    parts = spans.select(word, "st", (F.col("st") + F.col("len")).alias("en"), F.substring(F.col(word), F.col("st") + 1, F.col("len")).alias("piece"))
    return parts.join(checked_broadcast(vocab.select("piece", "score", "idx")), "piece").select(word, "st", "en", "piece", "score", "idx")


def best_path_fold(edges: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """(word, path): array of (st, en, idx) by a fold over the end positions, in expressions only.

    Meant for words: the fold looks at all edges of a word for each position.
    """
    held = edges.groupBy(word).agg(F.collect_list(F.struct("st", "en", "score", "idx")).alias("edges"))
    rows = words.select(word).join(held, word, "left").select(word, F.coalesce("edges", F.array().cast("array<struct<st:int,en:int,score:float,idx:bigint>>")).alias("edges"))
    zero = F.array(F.struct(F.lit(0.0).cast("float").alias("score"), F.lit(0).alias("st"), F.lit(0).cast("bigint").alias("idx")))

    def step(done: Column, k: Column) -> Column:
        ending = F.filter("edges", lambda e: e["en"] == k)
        sums = F.transform(ending, lambda e: F.struct((F.get(done, e["st"])["score"] + e["score"]).cast("float").alias("score"), (-e["st"]).alias("neg"), e["idx"].alias("idx")))
        top = F.array_max(sums)
        unknown = F.struct(F.lit(0.0).cast("float").alias("score"), (k - 1).alias("st"), F.lit(0).cast("bigint").alias("idx"))
        best = F.when(F.size(sums) == 0, unknown).otherwise(F.struct(top["score"].alias("score"), (-top["neg"]).alias("st"), top["idx"].alias("idx")))
        return F.concat(done, F.array(best))

    nodes = rows.select(word, F.aggregate(F.sequence(F.lit(1), F.length(word)), zero, step).alias("best"))
    start = F.struct(F.length(word).alias("at"), F.array().cast("array<struct<st:int,en:int,idx:bigint>>").alias("path"))

    def back(a: Column, _: Column) -> Column:
        node = F.get(F.col("best"), a["at"])
        one = F.struct(node["st"].alias("st"), a["at"].alias("en"), node["idx"].alias("idx"))
        return F.when(a["at"] > 0, F.struct(node["st"].alias("at"), F.concat(F.array(one), a["path"]).alias("path"))).otherwise(a)

    return nodes.select(word, F.aggregate(F.sequence(F.lit(1), F.length(word)), start, back)["path"].alias("path"))


def best_path_arrow(words: DataFrame, pieces: kernel.Pieces, word: str = "word") -> DataFrame:
    """(word, path) as ``best_path_fold``, with the pieces in a broadcast."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges, starts, ends, index, _ = shared.value.lattice.paths(b.column(0).to_pylist())
            nodes = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(index, pa.int64())], names=["st", "en", "idx"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), nodes)], names=[word, "path"])

    return spread(words.select(word)).mapInArrow(run, f"{word} string, path array<struct<st:int,en:int,idx:bigint>>")


def path_tokens(paths: DataFrame, word: str = "word") -> DataFrame:
    """(word, pos, token, unknown): the nodes of the paths in long form."""
    each = paths.select(word, F.posexplode("path").alias("pos", "n"))
    return each.select(word, "pos", F.substring(F.col(word), F.col("n.st") + 1, F.col("n.en") - F.col("n.st")).alias("token"), (F.col("n.idx") == 0).alias("unknown"), F.col("n.idx").alias("idx"))


def merge_unknown(tokens: DataFrame, key: str = "word") -> DataFrame:
    """(key, pos, token, unknown, run): runs of unknown tokens of a key become one; gaps and islands over the position."""
    by = Window.partitionBy(key).orderBy("pos")
    new = tokens.withColumn("new", F.when(F.col("unknown") & F.coalesce(F.lag("unknown").over(by), F.lit(False)), 0).otherwise(1))
    island = new.withColumn("island", F.sum("new").over(by))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return island.groupBy(key, "island").agg(F.array_join(parts, "").alias("token"), F.max("unknown").alias("unknown"), (F.count("*") > 1).alias("run")).select(
        key, (F.col("island") - 1).cast("int").alias("pos"), "token", "unknown", "run"
    )


def masks(tokens: Column, runs: Column) -> Column:
    """Mask numbers of an array of tokens; runs tells which are merged unknown runs. Each depends on its token and the one before."""

    def alone(t: Column, pattern: str) -> Column:
        return (F.length(t) == 1) & (F.octet_length(t) <= 3) & t.rlike(pattern)

    kinds = F.transform(tokens, lambda t: F.when(alone(t, r"^\p{P}$"), 2).when(alone(t, r"^\s$"), 1).when(~t.startswith(MARKER), 6).otherwise(0))

    def one(all_kinds: Column) -> Column:
        def mask(k: Column, i: Column) -> Column:
            after = F.coalesce(F.get(all_kinds, i - 1).isin(1, 2), F.lit(False))
            plain = F.when(F.get(runs, i), 8).otherwise(0)
            return F.when(k == 6, F.when(after, plain).otherwise(6)).when(k == 0, plain).otherwise(k)

        return F.transform(all_kinds, mask)

    return F.transform(F.array(kinds), one)[0]
