import os
import random

import edge
import pytest

from tessera.llm import ngramjoin as J


def sets(text, n):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, n, num, den):
    s = {d: sets(t, n) for d, t in docs}
    comp = {d: d for d in s}
    ids = sorted(s)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {d: (len(s[d]), comp[d]) for d in s}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 3)))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([1, 2, 3, 5, 20, 60, 150]))] + (passage if rnd.random() < 0.4 else [])
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(x.upper() if rnd.random() < 0.1 else x for x in w))
    rnd.shuffle(out)
    return list(enumerate(out))


def found(spark, docs, n, num):
    idx, comps = J.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), n=n, num=num, den=100)
    return {r.id: (r.size, r.component_id if r.component_id is not None else r.id) for r in idx.join(comps, "g", "left").collect()}


@pytest.mark.usefixtures("small_plans")
@pytest.mark.parametrize(("seed", "n", "num", "crowd"), [(1, 3, 90, 64), (2, 5, 80, 1), (3, 3, 50, 2), (4, 3, 100, 1)])
def test_components_against_brute_force(spark, monkeypatch, seed, n, num, crowd):
    """With a small CROWD the nodes of nearly every shared token are compared under their own order."""
    monkeypatch.setattr(J, "CROWD", crowd)
    docs = corpus(seed)
    assert found(spark, docs, n, num) == brute(docs, n, num, 100)


@pytest.mark.usefixtures("small_plans")
def test_pairs_of_a_crowd_are_not_listed(spark):
    """Near copies that differ too much to be linked: their first tokens are their own, so hardly any meet."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(300):
        w = list(base)
        for k in rnd.sample(range(40), 3):
            w[k] = f"own{i}x{k}"
        docs.append((i, " ".join(w)))
    sets_ = spark.createDataFrame([(i, [hash(x) for x in sets(t, 3)]) for i, t in docs], "g long, s array<long>")
    tokens = J.by_rarity(sets_, 90, 100).selectExpr("*", "g as c")
    rows = J.mixed(J.shown(tokens, 90, 100))
    assert J.met(rows, 90, 100).count() < 300
    assert found(spark, docs, 3, 90) == brute(docs, 3, 90, 100)


def test_repeated_ids_are_one_document(spark):
    """The sets of the rows of an id are alternatives: each can link it."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(1, a), (5, a + " x"), (5, b), (7, b + " y"), (9, "other words here")]
    got = {(r.doc_id, r.component_id) for r in J.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (9, 9)}


@pytest.mark.usefixtures("small_plans")
def test_hot_tokens_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_DOCS", 2)
    monkeypatch.setattr(J, "HOT", 50)
    docs = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 3, 90, 100)


def test_edges(spark):
    got = J.query(edge.documents(spark)).collect()
    assert len(got) == len(edge.rows())
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == 0 and by[1].component_id == 1 and by[5].component_id == 5 and by[100].component_id == 5 and by[3].n_shingles == 1
    docs = edge.documents(spark)
    kept = J.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert J.query(edge.empty(spark)).count() == 0


def test_keep_leaves_no_index(spark):
    """The index, with the prefixes of every document, lay in the shared folder beside all later stages."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared))
    docs = [(d, f"a b c d e f g h i j k l m {'x' if d % 3 else 'n'} o p q r s t u v w {d % 2}") for d in range(8)]
    kept = J.keep(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] and kept.count() < 8
    left = [spark.read.parquet(f"{shared}/{x}").columns for x in set(os.listdir(shared)) - before]
    assert not [c for c in left if {"p1", "size", "component_id"} & set(c)]
