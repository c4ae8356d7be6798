import time

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common as C


def test_a_bit_set_holds_its_keys_and_few_others(spark):
    """With 16 bits a key a single one a key let one of 16 others pass."""
    n = 1 << 14
    keys = C.cut(spark.range(n).select(F.xxhash64("id").alias("k")))
    bits = C.bit_filter(keys, "k")
    assert 64 * len(bits) == C.BITS_A_KEY * n
    own = np.array([r.k for r in keys.collect()], dtype=np.int64)
    assert C.may_hold(bits, own).all() and C.may_hold(bits, own.view(np.uint64)).all()
    rnd = np.random.default_rng(1)
    others = rnd.integers(-(1 << 63), 1 << 63, 200_000)
    assert C.may_hold(bits, others).mean() < 1 / 200
    assert len(C.may_hold(bits, others[:0])) == 0 and C.may_hold(None, others).all()


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    """They went when the driver happened to collect its garbage, and lay on disk with those of all later queries until then."""
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    out = C.cut(rows)
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert out.count() == 100 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert rows.where("n = 100").count() == C.cut(rows).count() == 100  # the same frame can be run again


def test_cut_has_the_driver_give_back_memory(spark, monkeypatch):
    """Only when much of its heap is used; nothing did before."""
    calls, real = [], getattr(C, "release", None)
    monkeypatch.setattr(C, "release", lambda s: (calls.append(s), real(s)), raising=False)
    for share, n in ((0.0, 1), (2.0, 1)):
        monkeypatch.setattr(C, "USED", share, raising=False)
        assert C.cut(spark.range(10)).count() == 10 and len(calls) == n
