import random
import re

import edge

from tessera.llm import licenses as C


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for p, label in C.BASE.items():
        w = p.split()
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w:
                starts.append(i), labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_places(spark):
    rnd = random.Random(3)
    parts = ["MIT", "license", "Apache", "General", "public", "License,", "the", "lesser", "MIT-License", "é", "x\n", "GENERAL  PUBLIC\tLICENSE"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in C.query(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_parser():
    assert C.parse("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert C.parse("(MIT or GPL-2.0-only) AND ISC") == ["MIT", "GPL-2.0-only", "or", "ISC", "and"]
    assert C.parse("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT") == ["GPL-2.0-only", "Classpath-exception-2.0", "with", "MIT", "and"]
    for bad in ("", "OR MIT", "(MIT", "()", "((MIT) OR", "*/"):
        assert C.parse(bad) is None
    for cut in ("MIT OR", "MIT)", "MIT Apache-2.0", "MIT int x;", "MIT (ISC)", "(MIT) OR (", "MIT OR AND ISC"):
        assert C.parse(cut) == ["MIT"]
    good = C.parse("(MIT OR GPL-2.0-only WITH X) AND Apache-2.0")
    assert C.identifiers(good) == ["MIT", "GPL-2.0-only", "Apache-2.0"]
    assert C.evaluate(good, {"MIT", "Apache-2.0"}.__contains__) and not C.evaluate(good, {"MIT"}.__contains__)


def test_tags():
    r = C.scan("// SPDX-License-Identifier: (MIT OR LGPL-2.1-only) AND BSD-2-Clause */\ncode\nReleased under the MIT License.")
    assert r[5] == "bsd,lgpl,mit" and r[4] == "mit" and r[6] > 0.95 and r[7] == ["MIT LGPL-2.1-only or BSD-2-Clause and"]
    assert C.scan("SPDX-License-Identifier: OR MIT")[7] == [] and C.scan("nothing here")[6] == 0


def test_verdicts_of_planted_tags(spark):
    tag = "SPDX-License-Identifier: "
    want = {
        "MIT OR GPL-2.0-only": (True, "gpl,mit"),
        "MIT AND GPL-2.0-only": (False, "gpl,mit"),
        "(GPL-2.0-only OR BSD-3-Clause) AND Apache-2.0": (True, "apache,bsd,gpl"),
        "GPL-2.0-only OR BSD-3-Clause AND LGPL-2.1-only": (False, "bsd,gpl,lgpl"),
        "Apache-2.0 WITH LLVM-exception": (True, "apache"),
        "Unheard-Of": (False, ""),
        "MIT */ int x = 1;": (True, "mit"),
        "OR": (None, ""),
    }
    texts = [f"/* {tag}{e}\ncode {i}" for i, e in enumerate(want)] + ["no tag", f"{tag}MIT\n{tag}GPL-3.0-only", None]
    got = {r.doc_id: (r.permitted, r.labels) for r in C.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [*want.values(), (None, ""), (False, "gpl,mit"), (None, "")]


def test_edges(spark):
    docs = edge.documents(spark)
    assert sorted(map(str, (r.row for r in C.licenses(docs).collect()))) == sorted(map(str, docs.collect()))
    for r in C.query(docs).collect():
        assert r.n_base == 0 and r.labels == "" and r.score == 0
    assert C.query(edge.empty(spark)).count() == 0
