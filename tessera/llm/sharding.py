"""Sharding by sampled splitters; the law is ``bytes``: shards of near equal size.

Rows are ordered by (hash of the text, id, row number), so equal texts stand together and no two rows are alike. A size-weighted
sample of about ``SAMPLE`` of these keys, whatever the input, gives quantile splitters;
each row finds its range by binary search; exact bytes and rows per range are added up (one row a range
reaches the driver); ranges over ``OVERFULL`` times their share are sampled again and subdivided until they fit or hold one row of
that size. Consecutive ranges make a shard. A large group of equal texts spans as many ranges as its bytes need.
Slots come from a row number within a range plus the rows of the ranges before it, so no shard is ever
gathered into one task. Built-in expressions only.

Null texts have size 1 and the checksum of no bytes; null ids sort first; repeated rows, with or without an id, are told apart by
their row number and spread like others, each with a slot of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unit

RANGES = 512
SAMPLE = 32 * RANGES
OVERFULL = 1.5
LEAST = -(1 << 63)
KEY = ("h", "d", "u")


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32 and its key (h, d, u). The row number u is settled when the rows are written."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.xxhash64(t).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("d"),
        F.monotonically_increasing_id().alias("u"),
    )


def sampled(rows: DataFrame, rate: float | Column, round_: int = 0) -> list[tuple[int, int, int]]:
    """Keys drawn in proportion to size, rate per byte, in key order.

    Each row draws an exponential variable whose rate is its size; those below the given rate are taken. So a task
    returns its part of the sample and no more, however many tasks there are.
    """
    drawn = rows.where(-F.log(unit(*KEY, F.lit(17 + round_))) / F.col("size") < rate)
    return sorted({(r.h, r.d, r.u) for r in drawn.select(*KEY).collect()})


def quantiles(keys: list, n: int) -> list:
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at most the key: a binary search over constant arrays."""
    if not splitters:
        return F.lit(0)
    arrays = [F.lit([s[k] for s in splitters]) for k in range(len(KEY))]
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]

    def go(low: Column, step: Column) -> Column:
        at = low + step
        (bh, bd, bu), (h, d, u) = (F.get(x, at - 1) for x in arrays), (F.col(k) for k in KEY)
        less = (bh < h) | ((bh == h) & ((bd < d) | ((bd == d) & (bu <= u))))
        return F.when((at <= len(splitters)) & less, at).otherwise(low)

    return F.aggregate(F.lit(steps), F.lit(0), go)


def totals(rows: DataFrame, splitters: list) -> dict[int, tuple[int, int, int]]:
    """Bytes, rows and largest row of each range that holds any."""
    found = rows.groupBy(range_of(splitters).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("most")).collect()
    return {r.r: (r.b, r.n, r.most) for r in found}


def ranges_of(rows: DataFrame, ranges: int, sample: int, rounds: int = 30) -> tuple[list, dict]:
    """Splitters and the totals of their ranges: no range of several rows exceeds OVERFULL shares, but for one that a single row fills."""
    total = rows.agg(F.sum("size")).first()[0]
    splitters = quantiles(sampled(rows, sample / total), ranges) if total else []
    share = (total or 0) / max(ranges, 1)
    for i in range(1, rounds):
        by = totals(rows, splitters)
        over = {r: b for r, (b, n, most) in by.items() if n > 1 and b > max(OVERFULL * share, 2 * most)}
        if not over:
            return splitters, by
        inside = rows.withColumn("r", range_of(splitters)).where(F.col("r").isin(list(over)))
        more: dict[int, list] = {r: [] for r in over}
        for k in sampled(inside, sample / ranges / share, i):  # as many keys a share as the first time, but others
            more[bisect_right(splitters, k)].append(k)
        for r, keys in more.items():
            splitters = sorted({*splitters, *quantiles(keys, int(over[r] / share) + 1)})
    raise RuntimeError(f"ranges are still overfull after {rounds} rounds")


def assign(rows: DataFrame, shards: int, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """rows (as of ``keyed``) with shard and slot; rows is read several times, so pass it written."""
    splitters, by = ranges_of(rows, ranges, sample)
    total, before, shard, offset, filled = sum(b for b, _, _ in by.values()), 0, [], [], [0] * shards
    for r in range(len(splitters) + 1):
        b, n, _ = by.get(r, (0, 0, 0))
        s = min(shards - 1, int((before + b / 2) * shards / total)) if total else 0
        before += b
        shard.append(s)
        offset.append(filled[s])
        filled[s] += n
    at = Window.partitionBy("r").orderBy(*KEY)
    return (
        rows.withColumn("r", range_of(splitters))
        .withColumn("k", F.row_number().over(at))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.get(F.lit(shard), F.col("r")).cast("int").alias("shard"),
            (F.get(F.lit(offset), F.col("r")) + F.col("k") - 1).cast("long").alias("slot"),
            F.col("r").alias("range_id"),
        )
    )


def query(docs: DataFrame, shards: int = 8) -> DataFrame:
    return assign(cut(keyed(docs)), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range_id"
    )
