"""The stages of the pipeline on a small corpus, each against what it should do to its own input."""

import random

import corpus_pipeline as P
from test_linededup import brute as lines_gone
from test_ngramjoin import brute as components

from tessera.llm import quality
from tessera.llm.common import cut


def corpus():
    rnd = random.Random(8)
    words = {"en": ["the", "thing", "other", "shower", "and", "handle"], "fr": ["élève", "leçon", "ouvrir", "les", "eaux"]}
    for lang in words:
        words[lang] += ["".join(rnd.choice(words[lang]) for _ in range(2)) for _ in range(400)]
    line = lambda lang: " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(9, 20))) + "."
    out = []
    for i in range(60):
        lang = rnd.choice(["en", "fr"])
        out.append((i, "\n".join(line(lang) for _ in range(rnd.randint(6, 12))), lang, "s", 0))
    out += [(100 + i, out[i][1], out[i][2], "copy", 0) for i in range(5)]
    out += [(200 + i, out[i + 5][1].replace("the", "these", 1).replace("les", "lez", 1), out[i + 5][2], "near", 0) for i in range(5)]
    out += [(300, "too short", "en", "s", 0), (301, None, None, None, None), (302, "1 2 3 " * 40, "en", "s", 0), (303, " ".join(rnd.choice(words["en"]) + "$$$" for _ in range(90)), "en", "s", 0)]
    return out


def test_stages(spark):
    docs = cut(spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long"))
    names = docs.columns
    steps = []
    for name, stage in P.STAGES:
        before, docs = docs, cut(stage(spark, docs, ""))
        steps.append((name, before, docs))
        assert name == "packing" or docs.columns == names
    rows = {name: ({r.doc_id: r.text for r in a.collect()}, b.collect()) for name, a, b in steps}
    before, after = rows["language_id"]
    assert set(before) - {r.doc_id for r in after} == {301, 302}
    before, after = rows["quality_rules"]
    kept = {r.doc_id for r in quality.query(steps[1][1]).collect() if r.kept}
    assert {r.doc_id for r in after} == kept and not kept & {300, 303} and set(range(60)) <= kept
    before, after = rows["line_dedup"]
    gone = lines_gone(list(before.items()))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])) for d, t in before.items()}
    assert {r.doc_id: r.text for r in after} == {d: t for d, t in want.items() if t.strip()}
    before, after = rows["ngram_join"]
    comp = components(list(before.items()), 5, 80, 100)
    assert {r.doc_id for r in after} == {d for d in before if comp[d][1] == d}
    before, after = rows["packing"]
    assert {r.doc_id for r in after} == set(before) and len(P.STAGES) == 5
