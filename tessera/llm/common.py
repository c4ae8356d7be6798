"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a Python worker gets at once; texts may be long, so batches are short.
ARROW_ROWS = 256
#: Bits of a broadcast bit set for each key, and in all at most (8 MB); bits that a key sets.
BITS_A_KEY = 16
FILTER_BITS = 1 << 26
PROBES = 4
#: ``cut`` has the driver give back memory when more than this share of its heap is used.
USED = 1 / 3
#: Spark deletes the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session that names none, as in tests, gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: ends the lineage and outlives lost executors.

    The folder goes when the application ends, or earlier by ``drop``; the shuffle files behind it go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    place, system = _file(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > USED * heap.maxMemory():
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Has the driver's two processes give back memory that they hold but do not use.

    Queries of many small jobs leave garbage, plans and broadcasts behind, for which the JVM enlarges its heap; Python's
    allocators keep what is freed, where they offer no way to give it back.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    spark._jvm.java.lang.System.gc()


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        place, system = _file(t.sparkSession, t._cut)
        system.delete(place, True)


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def bit_filter(keys: DataFrame, key: str, bits: int | None = None) -> np.ndarray | None:
    """The long column key as a set of bits, to be broadcast: what it does not hold is not in keys. keys is read twice, so pass it written.

    It has at least BITS_A_KEY bits a key, of which each key sets PROBES, so that one in 400 others passes at most. Where that exceeds bits (FILTER_BITS) there is none, and callers join instead.
    It only spares work: whatever passes is checked by a join or is harmless.
    """
    need = max(1 << 16, 1 << (BITS_A_KEY * keys.count() - 1).bit_length())
    if need > (bits or FILTER_BITS):
        return None
    first, step = F.col(key).bitwiseAND(F.lit(need - 1)), F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
    slots = keys.select(F.explode(F.array(*[(first + i * step).bitwiseAND(F.lit(need - 1)) for i in range(PROBES)])).alias("slot"))
    rows = slots.select(F.shiftright("slot", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("m"))
    out = np.zeros(need // 64, dtype=np.int64)
    found = rows.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def may_hold(filter_bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the set; without a set, all may."""
    if filter_bits is None:
        return np.ones(len(keys), dtype=bool)
    mask, at, keys = 64 * len(filter_bits) - 1, np.arange(len(keys)), keys.view(np.int64)
    for i in range(PROBES):
        left = keys[at]
        slot = ((left & mask) + i * (left >> 32 & 0xFFFFFFFF | 1)) & mask
        at = at[(filter_bits[slot >> 6] >> (slot & 63) & 1).astype(bool)]
    out = np.zeros(len(keys), dtype=bool)
    out[at] = True
    return out


def apart(df: DataFrame) -> DataFrame:
    """df, an aggregate, behind an exchange of its own: then both sides of a join on its key are exchanged for the join,
    and adaptive execution can split the other side's hot keys."""
    return df.hint("rebalance")


def unit(*cols: Column | str) -> Column:
    """A number in (0, 1) that depends on the columns only."""
    low = F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))
    return (low.cast("double") + 0.5) / float(1 << 52)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (id, component_id), the smallest id reachable.

    Alternates large-star and small-star steps, each a map-side-combined minimum and a join, until the
    edges no longer change. A hub is never gathered into one task: its neighbours stay rows.
    Nulls and loops are left out; an empty input gives an empty result.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    star = lambda: now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )
    state = lambda: tuple(now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first())
    seen = state()
    for _ in range(rounds):
        if not seen[0]:
            return star()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(apart(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        mark = state()
        if mark == seen:
            return star()
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
