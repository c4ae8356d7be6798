import random
import zlib

import edge
import numpy as np
import sentencepiece

from tessera.llm import sentpiece as S
from tessera.sources import protowire as W


def as_unigram(path):
    """The model file with its type set to unigram, for the library to segment by scores."""
    out = b""
    for number, value in W.fields(open(path, "rb").read()):
        if number == 2:
            body, at = b"", 0
            while at < len(value):
                key, p = W._varint(value, at)
                if key & 7 == 0:
                    _, end = W._varint(value, p)
                elif key & 7 == 2:
                    size, p = W._varint(value, p)
                    end = p + size
                else:
                    end = p + (8 if key & 7 == 1 else 4)
                if key >> 3 != 3:
                    body += value[at:end]
                at = end
            value = body + b"\x18\x01"
        out += bytes([number << 3 | 2]) + W._encode_varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def words(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdeéthingouanrs.,!") for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    model, library = S.model(S.default_model()), as_unigram(S.default_model())
    texts = [w for i in range(40) for w in words(i, 40)]  # single words: over whole texts the library's sums lose places
    for t, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t)


def test_best_is_the_plain_viterbi():
    model = S.model(S.default_model())
    score = {}
    file = W.read_model(S.default_model())
    for i, p in enumerate(file.pieces):
        if p.kind in (W.NORMAL, W.USER_DEFINED):
            score[p.text] = (p.score, i)
    for w in ["▁" + x for x in words(9, 80)] + ["▁日本🤔x", "▁▁▁a", "x" * 40]:
        best = [(0.0, [])]
        for k in range(1, len(w) + 1):
            found = []
            for s in range(max(0, k - 16), k):
                if w[s:k] in score:
                    found.append((best[s][0] + score[w[s:k]][0], -s, score[w[s:k]][1]))
                elif k - s == 1:
                    found.append((best[s][0] + model.unk_score, -s, -1 - ord(w[s])))
            top = max(found, key=lambda x: x[:2])
            best.append((top[0], [*best[-top[1]][1], top[2]]))
        assert model.best([w])[0].tolist() == best[-1][1]


ODD = ["", " ", "a  b ", " x", "\n\t x", "日本語 テスト 🤔", "Ϻ𩸽 z", "a\nb c\nd", "\n", "a \nb", "x\n\ny z"]


def test_round_trip():
    model = S.model(S.default_model())
    assert [model.decode(x) for x in model.encode(ODD)] == ODD
    assert model.encode([None]) == [b""]


def test_long_words_take_time_in_proportion():
    """Texts without spaces: the same ids as by the plain Viterbi, and no more than a few seconds for 400,000 characters."""
    import time

    model, rnd = S.model(S.default_model()), random.Random(5)
    text = "".join(rnd.choice("abcdeéthingouanrs日本.,!") for _ in range(400_000))
    began = time.time()
    ids = model.encode([text])
    assert time.time() - began < 10 and model.decode(ids[0]) == text
    word = "▁" + text[:600]
    short = S.Model(S.default_model())
    from tessera.operators import lattice

    old, lattice.LONG = lattice.LONG, 1 << 30
    try:
        whole = short.best([word])[0].tolist()
    finally:
        lattice.LONG = old
    assert model.best([word])[0].tolist() == whole


def test_columns_and_edges(spark):
    docs = edge.documents(spark)
    encoded = S.encode(docs)
    back = {(r.row.row.doc_id, r.row.row.text): r.text for r in S.decode(encoded).collect()}
    assert all((t or "") == b for (_, t), b in back.items())
    for r in S.query(docs).collect():
        assert r.round_trip
    one = {r.doc_id: r for r in S.query(docs).collect()}
    assert one[0].n_pieces == 0 and one[0].ids_crc32 == 0 and one[8].decoded_crc32 == zlib.crc32(edge.TEXTS[8].encode())
    assert S.query(edge.empty(spark)).count() == 0
