import random

import edge
import pytest

from tessera.llm import linededup as L


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """Numbers of the lines that go, per document, comparing all lines with all earlier ones."""
    first, gone = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for i, line in enumerate(t.split("\n")):
            w = tuple(line.encode().lower().split())
            if len(w) < L.LEAST:
                continue
            if w in first or len(w) >= L.NEAR and any(len(x) >= L.NEAR and within_one(w, x) for x in first):
                gone.setdefault(d, []).append(i)
            first.setdefault(w, (d, i))
    return gone


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcde") + rnd.choice(["", "x", "yy"])
    pool = [[word() for _ in range(rnd.choice([1, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33]))] for _ in range(40)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(0, 8)):
            w = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w) + 1)
                kind = rnd.randrange(3)
                w[at : at + (kind != 0)] = [word()] if kind < 2 else []
                w = w or ["z"]
            lines.append(rnd.choice(["", " "]) + rnd.choice([" ", "  "]).join(x.upper() if rnd.random() < 0.1 else x for x in w))
        docs.append((d, "\n".join(lines)))
    return docs


@pytest.mark.parametrize(("seed", "bits"), [(1, None), (2, None), (3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, bits):
    """With hardly any bits for filters, joins take their place."""
    if bits:
        monkeypatch.setattr("tessera.llm.common.FILTER_BITS", bits)
    docs = corpus(seed)
    want = brute(docs)
    got = {r.doc_id: r for r in L.query(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for d, t in docs:
        lines = t.split("\n")
        left = [x for i, x in enumerate(lines) if i not in want.get(d, [])]
        assert got[d].text == "\n".join(left) and got[d].n_removed == len(want.get(d, [])) and got[d].n_lines == len(lines)


def test_edit_distance_is_verified():
    rnd = random.Random(9)
    for _ in range(3000):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 6))] for _ in range(2))
        assert L.within_one_edit(a, b) == (a == b or within_one(a, b))


def test_equal_hashes_of_different_lines_are_not_enough(spark):
    """Pairs that the variants' hashes bring together are only removed if their words say so."""
    texts = spark.createDataFrame([(1, 1, "a b c d e"), (2, 2, "a b x d e"), (3, 3, "a y x d e")], "h1 long, h2 int, words string")
    pairs = spark.createDataFrame([(2, 2, 1, 1), (3, 3, 1, 1), (3, 3, 2, 2)], "h1 long, h2 int, p1 long, p2 int")
    assert sorted(r.h1 for r in L.verified(pairs, texts).collect()) == [2, 3]
    assert [r.h1 for r in L.verified(pairs.where("p1 = 1"), texts).collect()] == [2]


def test_edges(spark):
    docs = edge.documents(spark)
    got = L.dedup(docs).collect()
    assert len(got) == len(edge.rows())
    by = {}
    for r in got:
        by.setdefault(r.row.doc_id, []).append(r)
    assert by[0][0].text is None and by[0][0].n_lines == 0 and by[1][0].text == "" and by[9][0].text == edge.TEXTS[9]
    assert sorted(r.text or "" for r in by[None]) == ["", edge.TEXTS[5]]  # null ids come first
    assert [r.text for r in by[5]] == [""] * 3 and by[100][0].text == ""
    kept = L.keep(docs)
    assert kept.columns == docs.columns and 100 not in [r.doc_id for r in kept.collect()]
    assert L.query(edge.empty(spark)).count() == 0


def test_equal_lines_of_any_length_go(spark):
    docs = [(1, "All rights reserved.\n今日は良い天気です。\n\nx"), (2, "ALL  rights reserved.\n今日は良い天気です。\n\none more"), (3, "all rights reserved.\nx\n "), (4, "all rights\nx y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in L.query(df).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("\none more", 2), 3: (" ", 2), 4: (docs[3][1], 0)}
    kept = L.keep(df.selectExpr("doc_id", "text", "cast(length(text) as bigint) as n_chars"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
