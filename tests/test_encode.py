"""Truncation and overflow against a loop, errors, decoding."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import decode as D
from tessera.operators import encode as E
from tessera.schema import TOKEN_IDS, Truncation
from tessera.sources.vocab import SpecialTokens, Vocab

SIZES = range(0, 6)


def loop(a, b, r, strategy, stride):
    """(kept a, kept b, overflow) by removing one token at a time; None if that is not allowed."""
    a, b, gone = list(a), None if b is None else list(b), []
    if r == 0:
        return a, b, []
    if b is None:
        if len(a) < r or strategy in (Truncation.ONLY_SECOND, Truncation.DO_NOT_TRUNCATE):
            return None
        gone, a = a[len(a) - r :], a[: len(a) - r]
        return a, b, (a[-min(stride, len(a)) :] if stride and a else []) + gone
    if strategy == Truncation.LONGEST_FIRST:
        if len(a) + len(b) < r:
            return None
        for _ in range(r):
            gone.insert(0, a.pop() if len(a) >= len(b) else b.pop())
        kept = a
    elif strategy == Truncation.ONLY_FIRST:
        if len(a) < r:
            return None
        gone, a = a[len(a) - r :], a[: len(a) - r]
        kept = a
    elif strategy == Truncation.ONLY_SECOND:
        if len(b) < r:
            return None
        gone, b = b[len(b) - r :], b[: len(b) - r]
        kept = b
    else:
        return None
    return a, b, (kept[-min(stride, len(kept)) :] if stride and kept else []) + gone


def row(ids):
    return None if ids is None else (ids, [(i, i + 1) for i in range(len(ids))], [[i] for i in range(len(ids))], [0] * len(ids))


@pytest.mark.parametrize("strategy", list(Truncation))
def test_truncation_is_the_loop(spark, strategy):
    pairs = list(itertools.product(SIZES, [None, *SIZES]))
    rows = [(i, row(list(range(100, 100 + n))), row(None if m is None else list(range(200, 200 + m)))) for i, (n, m) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"k int, a {TOKEN_IDS}, b {TOKEN_IDS}").cache()
    template = E.Template(0, 2)
    for max_len, stride in ((1, 0), (5, 0), (6, 2), (9, 3), (30, 1)):
        got = {r.k: r.encoded for r in E.encode_tokens(df, "a", "b", template, max_len, strategy, stride, on_error="null").collect()}
        for i, (n, m) in enumerate(pairs):
            a, b = list(range(100, 100 + n)), None if m is None else list(range(200, 200 + m))
            r = max(0, n + (m or 0) + template.overhead(b is not None) - max_len)
            want = loop(a, b, r, strategy, stride)
            if want is None:
                assert got[i].error.startswith("Value error: ") and got[i].token_ids == []
                continue
            x, y, over = want
            assert got[i].error is None and got[i].num_truncated_tokens == r and got[i].overflowing_tokens == over
            assert got[i].token_ids == [0, *x, 2] + ([] if b is None else [2, *y, 2])
            assert len(got[i].token_offsets) == len(got[i].reference_offsets) == len(got[i].masks) == len(got[i].token_ids)


def test_errors_are_raised(spark):
    df = spark.createDataFrame([(row([1, 2, 3]),)], f"a {TOKEN_IDS}")
    with pytest.raises(Exception, match="no truncation requested"):
        E.encode_tokens(df, "a", None, E.Template(0, 2), 4, Truncation.DO_NOT_TRUNCATE).collect()


def test_decoding(spark):
    vocab = Vocab({"<s>": 0, "</s>": 1, "<unk>": 2, "▁hello": 3, "▁world": 4, "!": 5}, SpecialTokens(unk="<unk>", cls="<s>", eos="</s>"))
    rows = spark.createDataFrame([(0, [0, 3, 4, 5, 1]), (1, [99]), (2, []), (3, None)], "k int, ids array<bigint>")
    get = lambda **o: {r.k: r.text for r in D.decode(rows, vocab, **o).collect()}
    assert get() == {0: "<s> ▁hello ▁world ! </s>", 1: "<unk>", 2: "", 3: ""}
    assert get(skip_special=True, clean_up=True)[0] == "▁hello ▁world!"
    tokens = D.ids_to_tokens(rows, vocab, skip_special=True)
    again = spark.createDataFrame([(0, [None, 3, 99, 0]), (0, [4])], "k int, ids array<bigint>")  # repeated keys stay apart
    assert sorted(r.tokens for r in D.ids_to_tokens(again, vocab).collect()) == [["<unk>", "▁hello", "<unk>", "<s>"], ["▁world"]]
    assert {r.k: r.t for r in tokens.select("k", D.detokenize(F.col("tokens")).alias("t")).collect()}[0] == " hello world!"
