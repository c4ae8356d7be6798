"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised in double precision. Tables of random projections, shifted and cut into steps of ``WIDTH``, hash them;
equal cells of a table make a bucket. How many projections a table has and how many tables there are follows from the number of
vectors (``parameters``): so many projections that a vector meets at most about ``CHANCE`` unrelated ones in all
tables, and so many tables that a pair at the threshold meets with probability ``RECALL``, closer ones almost always. The
tables grow as a power of about 0.27 of the number of vectors, the candidates in proportion to it.

Copies are not expanded into pairs: equal vectors are one node with a count. Every node is compared with the smallest id of each of its
buckets; those within half the angle of the threshold around one leader form a class, and any two members of a
class are linked by the triangle inequality, so their links are counted, not listed. Then only buckets with
several classes are joined, class against class, and each candidate pair is checked by its exact cosine.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths are never linked. Null ids link with nothing. Rows that repeat an id are one vector (the smallest
in array order); each row is returned. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, components, cut, drop, short_batches

COSINE = 0.9
WIDTH = 2.0
#: Probability that a pair at the threshold shares a bucket, and unrelated vectors that share one with a vector, as expected.
RECALL = 0.96
CHANCE = 8.0
SEED = 5


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two points at that distance into the same step."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def parameters(n: int, threshold: float = COSINE) -> tuple[int, int]:
    """(tables, projections) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    for k in range(4, 200):
        tables = math.ceil(math.log(1 - RECALL) / math.log1p(-(near**k)))
        if n * tables * far**k <= CHANCE:
            break
    return tables, k


def _stack(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(first row, vectors) of runs of equally long lists."""
    sizes = np.diff(column.offsets.to_numpy())
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at, out = 0, []
    for a, b in zip(edges, edges[1:]):
        if b > a:
            n = int(sizes[a]) * (b - a)
            out.append((a, flat[at : at + n].reshape(b - a, int(sizes[a]))))
            at += n
    return out


def _projection(dims: int, tables: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dims))
    return rng.standard_normal((dims, tables * k)), rng.uniform(0, 1, tables * k), rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) * 2 + 1


def keys(vectors: DataFrame, tables: int, k: int, width: float = WIDTH) -> DataFrame:
    """(id, keys) of (id, v): one 64-bit bucket key per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for b in batches:
            made = np.zeros((b.num_rows, tables), dtype=np.int64)
            for at, v in _stack(b.column(1)):
                dims = v.shape[1]
                if dims not in known:
                    known[dims] = _projection(dims, tables, k)
                a, shift, mult = known[dims]
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                cells = np.floor(unit @ a / width + shift).astype(np.int64).reshape(len(v), tables, k)
                h = (cells * mult).sum(axis=2) + np.arange(tables) * 0x1F3D5B79 + dims
                made[at : at + len(v)] = h ^ (h >> 29)
            flat = pa.array(made.reshape(-1))
            edges = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edges, flat)], names=["id", "keys"])

    short_batches(vectors.sparkSession)
    return vectors.select("id", "v").mapInArrow(run, "id long, keys array<long>")


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cos) of candidate pairs (a, b)."""
    both = pairs.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, -1.0)
            same = np.diff(b.column(2).offsets.to_numpy()) == np.diff(b.column(3).offsets.to_numpy())
            rows = np.flatnonzero(same)
            kept = b.take(pa.array(rows))
            for (at, x), (_, y) in zip(_stack(kept.column(2)), _stack(kept.column(3))):
                out[rows[at : at + len(x)]] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["a", "b", "cos"])

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cos double")


def valid(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def links(vectors: DataFrame, threshold: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(classes, cross) of written vectors (id, v): (id, leader) with all members of a leader's class linked, and all other linked pairs found (a < b)."""
    cells = cut(keys(vectors, *parameters(vectors.count(), threshold)).select("id", F.explode("keys").alias("k")))
    lead = cells.groupBy("k").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("k", "lead")
    shared = cut(cells.join(apart(lead), "k"))
    drop(cells)
    star = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    half = math.cos(math.acos(threshold) / 2) + 1e-12
    found = cut(cosines(star, vectors).where(F.col("cos") >= half).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")))
    led = found.select(F.col("leader").alias("id")).distinct().join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("leader"))
    classes = cut(found.unionByName(led))
    own = shared.select("k", "id").join(apart(classes), "id", "left").select("k", "id", F.coalesce("leader", "id").alias("c"))
    mixed = own.groupBy("k").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("k")
    members = cut(own.join(apart(mixed), "k"))
    groups = members.select("k", "c").distinct()
    couples = groups.select("k", F.col("c").alias("c1")).join(groups.select("k", F.col("c").alias("c2")), "k").where("c1 < c2")
    left = members.select("k", F.col("c").alias("c1"), F.col("id").alias("x"))
    right = members.select("k", F.col("c").alias("c2"), F.col("id").alias("y"))
    pairs = couples.join(left, ["k", "c1"]).join(right, ["k", "c2"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    cross = cut(cosines(pairs, vectors).where(F.col("cos") >= threshold))
    drop(shared, found, members)
    return classes, cross


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    one = base.where(F.col("vec_id").isNotNull() & valid(F.col("v"))).groupBy(F.col("vec_id").alias("id")).agg(F.min("v").alias("v"))
    good = cut(one.select("id", "v", F.xxhash64("v").alias("g"), F.xxhash64(F.lit(1), "v").alias("h")))
    nodes = cut(good.groupBy("g", "h").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")))
    classes, cross = links(nodes.select("id", "v"), threshold)
    weight = nodes.select("id", "m")
    sized = classes.join(weight, "id")
    sizes = sized.groupBy("leader").agg(F.sum("m").alias("n"))
    within = classes.join(apart(sizes), "leader").select("id", (F.col("n") - 1).alias("n"))
    alone = weight.join(classes, "id", "left_anti").select("id", (F.col("m") - 1).alias("n"))
    ends = cross.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(cross.select(F.col("b").alias("id"), F.col("a").alias("other")))
    across = ends.join(weight.select(F.col("id").alias("other"), F.col("m").alias("n")), "other").groupBy("id").agg(F.sum("n").alias("n"))
    counted = within.unionByName(alone).unionByName(across).groupBy("id").agg(F.sum("n").alias("n_links"))
    # the members of a class stand in a star around its smallest member, whether or not the leader is one of them
    star = classes.join(apart(classes.groupBy("leader").agg(F.min("id").alias("b"))), "leader").select(F.col("id").alias("a"), "b")
    comps = components(star.unionByName(cross.select("a", "b")))
    done = nodes.select("g", "h", "id").join(counted, "id").join(comps, "id", "left").select("g", "h", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    found = good.select("id", "g", "h").join(apart(done), ["g", "h"]).select("id", "n_links", "component_id")
    lowest = F.coalesce("component_id", "vec_id")
    return (
        base.select("vec_id")
        .join(found, F.col("vec_id") == found["id"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), lowest.alias("component_id"), F.coalesce(lowest == F.col("vec_id"), F.lit(False)).alias("kept"))
    )


def query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
