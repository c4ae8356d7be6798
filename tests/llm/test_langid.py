import math
import random
from collections import Counter

import edge
import numpy as np

from tessera.llm import langid as L

WORDS = {"aa": ["kato", "milo", "ruta", "sona"], "bb": ["xeng", "thrik", "wumb", "grath"], "cc": ["élée", "ouïr", "çafi", "nuée"]}


def text(rnd, lang, n=60):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", ".", "!"]) for _ in range(n))


def kneser_ney(seqs):
    """Log-probability function by dictionaries; sequences start with their boundary."""
    raw = {k: Counter() for k in range(1, L.ORDER + 1)}
    pads = [(0,) * (L.ORDER - 1) + tuple(int(x) for x in s) for s in seqs]
    for s in pads:
        for i in range(L.ORDER, len(s)):
            for k in raw:
                raw[k][s[i - k + 1 : i + 1]] += 1
    counts = {L.ORDER: raw[L.ORDER]}
    for k in range(1, L.ORDER):
        counts[k] = Counter(g[1:] for g in raw[k + 1])
    d = {}
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[k] = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)

    def p(ctx, w):
        if not ctx and not p.k1:
            return 1 / L.SYMBOLS
        k = len(ctx) + 1
        total = sum(v for g, v in counts[k].items() if g[:-1] == ctx)
        low = 1 / L.SYMBOLS if k == 1 else p(ctx[1:], w)
        if not total:
            return low
        kinds = sum(g[:-1] == ctx for g in counts[k])
        return max(counts[k][(*ctx, w)] - d[k], 0) / total + d[k] * kinds / total * low

    p.k1 = True
    return lambda s: [math.log(p(tuple(x[i - L.ORDER + 1 : i]), x[i])) for x in [(0,) * (L.ORDER - 1) + tuple(int(c) for c in s)] for i in range(L.ORDER, len(x))]


def test_model_is_interpolated_kneser_ney():
    rnd = random.Random(2)
    texts = {lang: [text(rnd, lang, 12) for _ in range(8)] for lang in WORDS}
    model = L.Model(texts)
    for j, lang in enumerate(model.langs):
        brute = kneser_ney([L.symbols(t) for t in texts[lang]])
        for probe in (texts[lang][0], text(rnd, "aa", 5), "zz élth q"):
            s = L.symbols(probe)
            assert np.allclose(model.steps(s)[:, j], brute(s), atol=1e-4)


def test_held_out_accuracy_and_columns(spark):
    rnd = random.Random(4)
    rows = [(i, text(rnd, lang, rnd.randint(3, 80)), lang) for i in range(600) for lang in [rnd.choice(list(WORDS))]]
    got = L.query(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 250 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.98 and np.mean([r.rejected for r in got]) < 0.03


def junk(rnd, n=400):
    return "".join(rnd.choice("qwzjkvxpyb ") for _ in range(n))


def test_rejection():
    rnd = random.Random(6)
    model = L.Model({lang: [text(rnd, lang) for _ in range(40)] for lang in WORDS})
    assert model.predict([junk(rnd)])[2] == [True] and model.predict([text(rnd, "bb")])[2] == [False]


def test_calibrated_rejection_in_spark(spark):
    """Junk goes, texts of the languages stay but for about the stated share, whatever their length."""
    rnd = random.Random(12)
    rows = [(i, text(rnd, lang, rnd.choice([2, 8, 40, 200])), lang) for i in range(2000) for lang in [rnd.choice(list(WORDS))]]
    bad = [(10000 + i, junk(rnd, rnd.choice([40, 400])), None) for i in range(40)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string").repartition(4)
    kept = {r.doc_id for r in L.keep(docs).collect()}
    assert not any(r[0] in kept for r in bad)
    assert np.mean([r[0] not in kept for r in rows]) < 4 * L.FALSE_REJECTIONS


def test_long_texts_are_scored_in_blocks(monkeypatch):
    rnd = random.Random(3)
    model = L.Model({lang: [text(rnd, lang, 12) for _ in range(8)] for lang in WORDS})
    seqs = [L.symbols(text(rnd, lang, n)) for lang, n in (("aa", 300), ("bb", 1), ("cc", 77), ("aa", 5))]
    whole = [model.steps(s).sum(axis=0, dtype=np.float64) for s in seqs]
    for size in (7, 64, 1 << 17):
        monkeypatch.setattr(L, "BLOCK", size)
        assert np.allclose(model._sums(seqs), whole, rtol=1e-5)


def test_edges(spark):
    docs = edge.documents(spark)
    got = L.identify(docs, L.train(docs)).collect()
    assert len(got) == len(edge.rows())
    for r in got:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected))
    assert L.keep(docs).columns == docs.columns
    assert L.query(edge.empty(spark)).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.Model({})).collect()} == {"und"}


def test_every_label_gets_a_model(spark):
    rnd = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4 * 70)]
    rows = []
    for k in range(70):
        own = letters[4 * k : 4 * k + 4]
        rows += [(len(rows) + i, "".join(rnd.choice([*own, " "]) for _ in range(80)), f"l{k:02}") for i in range(4 if k < 64 else 3)]
    docs = spark.createDataFrame([*rows, (-1, "no label", None)], "doc_id long, text string, lang string").repartition(4)
    model = L.train(docs)
    assert model.langs == sorted({r[2] for r in rows})
    assert model.predict([r[1] for r in rows])[0] == [r[2] for r in rows]
    assert {r.doc_id for r in L.keep(docs).collect()} >= {r[0] for r in rows}
