"""Best paths, unknown runs and masks, against straightforward versions."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import kernel as K
from tessera.operators import segment as S
from tessera.schema import Mask


def pull(pieces: list[tuple[str, float]], text: str) -> list[tuple[int, int, int]]:
    """The best path, position by position, in single precision."""
    table = {t: (np.float32(s), i) for i, (t, s) in enumerate(pieces) if t}
    best, back = [np.float32(0)], [None]
    for k in range(1, len(text) + 1):
        found = [(best[s] + table[text[s:k]][0], s, table[text[s:k]][1]) for s in range(k) if text[s:k] in table]
        top = max(found, key=lambda x: (x[0], -x[1])) if found else (np.float32(0), k - 1, 0)
        best.append(top[0]), back.append((top[1], k, top[2]))
    out, k = [], len(text)
    while k:
        out.append(back[k])
        k = back[k][0]
    return out[::-1]


PIECES = [("<unk>", 0.0), ("▁", -0.5), ("a", -1.25), ("ab", -2.0), ("b", -3.0), ("▁a", -1.0), ("aba", -2.5), ("cc", -0.1), ("▁ab", -3.3)]


@given(st.text(alphabet="abcd▁", max_size=30))
@settings(max_examples=300, deadline=None)
def test_best_path_is_the_pull_form(text):
    assert K.Pieces(PIECES).best_path(text) == pull(PIECES, text)


def test_fold_equals_arrow(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcd▁") for _ in range(rnd.randint(1, 12))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    vocab = spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(PIECES)], "piece string, score float, idx bigint")
    edges = S.prefix_search(df, vocab, 5)
    fold = {r.word: [tuple(x) for x in r.path] for r in S.best_path_fold(edges, df).collect()}
    arrow = {r.word: [tuple(x) for x in r.path] for r in S.best_path_arrow(df, K.Pieces(PIECES)).collect()}
    assert fold == arrow == {w: pull(PIECES, w) for w in words}


def test_unknown_resets_the_score():
    pieces = [("<unk>", 0.0), ("▁", -0.5), ("ab", -2.0), ("b", -3.0)]
    assert K.Pieces(pieces).best_path("▁ab▁ab") == [(0, 1, 1), (1, 3, 2), (3, 4, 1), (4, 5, 0), (5, 6, 3)]


def test_unknown_runs(spark):
    t = K.Tokenizer.from_pieces([K.Piece("<unk>"), K.Piece("<s>"), K.Piece("</s>"), K.Piece("▁", -1.0), K.Piece("a", -1.0)])
    found = t.tokenize("a xyz ax!")
    assert [x.text for x in found] == ["▁", "a", "▁", "xyz", "▁", "a", "x!"]
    assert found[3].refs == [4] and found[3].mask == Mask.CONTINUATION
    tokens = S.path_tokens(S.best_path_arrow(spark.createDataFrame([("▁axyza",)], "word string"), t.pieces))
    rows = sorted(S.merge_unknown(tokens).collect(), key=lambda r: r.pos)
    assert [(r.token, r.unknown, r.run) for r in rows] == [("▁", False, False), ("a", False, False), ("xyz", True, True), ("a", False, False)]


def test_masks_fold_equals_kernel(spark):
    rnd = random.Random(5)
    cases = [[rnd.choice(["▁a", "a", "!", "▁", ".", "ab", "▁!", " "]) for _ in range(rnd.randint(0, 8))] for _ in range(200)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, c, [False] * len(c)) for i, c in enumerate(cases)], "k int, t array<string>, r array<boolean>")
    got = {r.k: r.m for r in df.select("k", S.masks(F.col("t"), F.col("r")).alias("m")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == [int(x.mask) for x in K.populate_masks([K.Token(t, []) for t in c])]


def test_word_mode_equals_exact():
    t = K.Tokenizer.from_pieces([K.Piece("<unk>"), K.Piece("<s>"), K.Piece("</s>")] + [K.Piece(p, s) for p, s in [("▁", -1.0), ("a", -1.5), ("b", -2.0), ("ab", -1.25), ("▁a", -2.0), (".", -1.0)]])
    assert t.pieces.closed(t.vocab.special_values)
    for text in ("ab ab  ba.", "  a", "b <mask> ab", "", "   ", "aaaa bbbb ab.ab"):
        assert t.word_ids(text) == t.ids(text)


@given(st.lists(st.text(alphabet="abcd▁ü🤔", max_size=20), max_size=8))
@settings(max_examples=200, deadline=None)
def test_lattice_of_many_words(words):
    """Words together, and long ones walked alone in blocks, have the paths of each alone."""
    from tessera.operators import lattice

    want = [pull(PIECES, w) for w in words]
    for long, block in ((512, 1 << 19), (1, 1 << 19), (1, 5), (4, 7)):
        old = lattice.LONG, lattice.BLOCK
        lattice.LONG, lattice.BLOCK = long, block
        try:
            edges, starts, ends, index, _ = K.Pieces(PIECES).lattice.paths(words)
        finally:
            lattice.LONG, lattice.BLOCK = old
        flat = list(zip(starts.tolist(), ends.tolist(), index.tolist()))
        assert [flat[a:b] for a, b in zip(edges, edges[1:])] == want


def test_sums_that_may_round_are_walked_whole():
    """With scores that are no multiples of a large power of two, long texts are not cut into words."""
    rnd = random.Random(1)
    pieces = [K.Piece("<unk>"), K.Piece("<s>"), K.Piece("</s>"), *[K.Piece(p, -rnd.random() * 3 - 1) for p in ("▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "▁ab", "ca")]]
    t = K.Tokenizer.from_pieces(pieces)
    assert t.pieces.closed(t.vocab.special_values) and 0 < t.pieces.exact_below() < 16
    text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(250))
    norm = t.normalized_text(text)
    whole = pull([(p.text, p.score) for p in pieces], norm)
    assert t.ids(text) == [t.vocab.token_to_id(norm[a:b]) for a, b, _ in whole]
    assert K.Pieces([("<unk>", 0.0), ("a", -1.125), ("b", -20.0)]).exact_below() == 2.0 ** 21
    assert K.Pieces([("<unk>", 0.0), ("a", -3.0)]).exact_below() == 2.0 ** 24
