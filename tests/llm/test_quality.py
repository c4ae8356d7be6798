import random
import re
from collections import Counter

import edge

from tessera.llm import quality as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_and_verdicts(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["a", "bb", "c#", "d|", "e"]) + rnd.choice(["", "", "\n"]) for _ in range(rnd.randint(0, 90))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.query(df).collect():
        n, chars, symbols, lines, repeated = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert r.kept == (r.fail_bits == 0) and not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    led = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "fail_bits long")
    kept = lambda v: [r.kept for r in Q.apply_policy(led, v).orderBy("fail_bits").collect()]
    assert kept("v1") == [True, False, False, False, True, True] and kept("v2") == [True] + [False] * 5
    found = {(r.policy, r.rule): (r.fails, r.only_this, r.rejected_without) for r in Q.ablation(led).collect()}
    assert found[("v1", "few_words")] == (3, 2, 1) and found[("v1", "repeated_windows")] == (1, 0, 3)
    assert found[("v2", "capitals")] == (1, 1, 4) and ("v1", "capitals") not in found


def test_edges(spark):
    docs = edge.documents(spark)
    got = Q.ledger(docs).collect()
    assert len(got) == len(edge.rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.row.text)
    assert Q.keep(docs).columns == docs.columns and Q.query(edge.empty(spark)).count() == 0


def test_every_rule_rejects_something_by_itself(spark):
    """A planted text for each rule that fails it and no other, and the ablation that says so."""
    rnd = random.Random(4)
    word = lambda n=6: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    words = lambda k, n=6: " ".join(word(n) for _ in range(k))
    planted = {
        "few_words": words(10),
        "repeated_windows": " ".join([words(20)] * 5),
        "symbols": words(80) + " " + "### $$$ %%% &&&",
        "repeated_lines": "\n".join(f"x\nx\n{words(12)}" for _ in range(9)),
        "short_words": " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)),
        "long_words": words(60, 20),
        "capitals": words(80).upper(),
    }
    assert set(planted) == set(Q.RULES)
    rows = [(i, t) for i, t in enumerate(planted.values())] + [(100, words(90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fail_bits for r in Q.query(docs).collect()}
    assert got == {i: Q.BIT[name] for i, name in enumerate(planted)} | {100: 0}
    found = {(r.policy, r.rule): (r.fails, r.only_this, r.rejected_without) for r in Q.ablation_query(docs).collect()}
    assert all(found["v2", name] == (1, 1, len(planted) - 1) for name in planted) and found["v1", "few_words"] == (1, 1, 1)
