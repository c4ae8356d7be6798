import zlib
from collections import defaultdict

import edge
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding as S


def check(rows, texts, shards=8):
    by = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by[s]) for s in range(shards)]


@pytest.mark.parametrize("hot", [0, 1500])
def test_shards_are_near_equal(spark, hot):
    texts = {i: f"text {i} " * (1 + i % 37) for i in range(4000)} | {i: "the same text " * 20 for i in range(hot)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = S.query(df).collect()
    assert len(rows) == 4000
    sizes = check(rows, texts)
    mean = sum(sizes) / 8
    assert max(abs(x - mean) for x in sizes) < 0.02 * mean
    if not hot:  # equal texts stand together unless their range is overfull
        assert len({(r.text_crc32, r.shard) for r in rows}) == len({r.text_crc32 for r in rows})


def test_range_of_is_a_search(spark):
    splitters = sorted({(x * 7919 % 1000 - 500, x % 5, x % 3) for x in range(300)})
    rows = [(h, d, u) for h in range(-510, 510, 5) for d in range(-1, 6) for u in range(-1, 4)]
    df = spark.createDataFrame(rows, "h long, d long, u long").select("h", "d", "u", S.range_of(splitters).alias("r"))
    for r in df.collect():
        assert r.r == sum(s <= (r.h, r.d, r.u) for s in splitters)
    assert df.select(S.range_of([]).alias("r")).where("r <> 0").count() == 0


@pytest.mark.parametrize("ident", [None, 7])
def test_rows_that_are_all_alike_are_spread(spark, ident):
    texts = [(ident, "the same text " * 20)] * 3000 + [(i, f"text {i} " * (1 + i % 37)) for i in range(1000)]
    rows = S.query(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in by[s]) for s in range(8)]
    assert len(rows) == 4000 and max(abs(x - sum(sizes) / 8) for x in sizes) < 0.02 * sum(sizes) / 8
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())


def test_few_huge_rows(spark):
    """Ranges that one row fills are left, all others are divided."""
    texts = [(i, "x" * (200000 if i < 5 else 10)) for i in range(500)]
    rows = S.keyed(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    splitters, by = S.ranges_of(rows, 16, 64)
    share = sum(b for b, _, _ in by.values()) / 16
    assert all(n == 1 or b <= max(S.OVERFULL * share, 2 * most) for b, n, most in by.values()) and sum(n for _, n, _ in by.values()) == 500


def test_edges(spark):
    docs = edge.documents(spark)
    rows = S.query(docs).collect()
    assert len(rows) == len(edge.rows()) and {0 <= r.shard < 8 for r in rows} == {True}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert S.query(edge.empty(spark)).count() == 0
    assert S.query(spark.range(1).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).first().size == 1
