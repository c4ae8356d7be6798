import random

import numpy as np

from tessera.llm import hashing as H


def test_long_texts_in_parts(monkeypatch):
    """Word hashes do not depend on how texts are grouped or cut."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcé語") for _ in range(rnd.choice([1, 3, 40])))
    texts = [(rnd.choice([" ", "\n", "\t  "])).join(word() for _ in range(rnd.choice([0, 1, 5, 300]))).encode() for _ in range(60)] + [b"", b" \n", ("x" * 5000).encode()]
    whole = H.text_words(texts)
    assert len(whole[1]) == len(texts) + 1 and [len(t.split()) for t in texts] == np.diff(whole[1]).tolist()
    one_by_one = [H.text_words([t])[0] for t in texts]
    assert np.array_equal(np.concatenate(one_by_one), whole[0])
    for most in (16, 100, 1000):
        monkeypatch.setattr(H.chunks, "__defaults__", (most,))
        found = H.text_words(texts)
        assert np.array_equal(found[0], whole[0]) and np.array_equal(found[1], whole[1])
