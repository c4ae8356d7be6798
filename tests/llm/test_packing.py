import zlib
from collections import defaultdict

import edge
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as K


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.default_vocabulary())
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_id_lies_in_one_piece(spark):
    texts = [f"Some words, {i} and more.\nAnother line here! " * (i % 400) + "end" for i in range(500)]
    ids = reference(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in K.query(df).collect():
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and len(want) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        docs[r.doc_id].append((r.start, r.length)), bins[r.sequence_id].append((r.offset, r.length))
    for i, parts in docs.items():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)]))[:-1] and sum(n for _, n in parts) == len(ids[i])
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)]))[:-1]
        assert sum(n for _, n in parts) <= 2048 and len(parts) <= K.SEGMENTS
    assert 2048 * len(bins) < 1.08 * sum(map(len, ids)) + 3 * 2048


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 60)), max_size=60), st.sampled_from([0, 4]), st.booleans())
@settings(max_examples=200, deadline=None)
def test_place_keeps_all_limits(pieces, least_cut, carry):
    """Pieces of n tokens of which the first k bear no loss."""
    limit = np.array([64.0, 5.0, 61.0])
    loss = [np.maximum(np.arange(n + 1) - k, 0) for n, k in pieces]
    bins, rest = K.place(loss, limit, least_cut, carry)
    parts = defaultdict(list)
    for own in [*bins, *([rest] if rest else [])]:
        assert sum(b - a for _, a, b in own) <= 64 and len(own) <= 5 and sum(loss[i][b] - loss[i][a] for i, a, b in own) <= 61
        for i, a, b in own:
            parts[i].append((a, b))
    for i, (n, _) in enumerate(pieces):
        assert sorted(parts[i])[0][0] == 0 and sorted(parts[i])[-1][1] == n and sum(b - a for a, b in parts[i]) == n
        assert least_cut or len(parts[i]) == 1


def test_every_limit_binds():
    """Each of the three limits ends some sequences while the others have room."""
    loss = [np.arange(401)] * 20 + [np.arange(11)] * 60 + [np.zeros(301, dtype=np.int64)] * 20
    bins, _ = K.place(loss, np.array([1000.0, 8.0, 700.0]), 8)
    full = lambda own: (sum(b - a for _, a, b in own), len(own), sum(int(loss[i][b] - loss[i][a]) for i, a, b in own))
    found = [full(own) for own in bins]
    assert any(t == 1000 for t, _, _ in found) and any(n == 8 and t < 1000 for t, n, _ in found) and any(b == 700 for _, _, b in found)


def test_loss_of_documents_and_of_conversations(spark):
    """The first line of a document bears no loss; of a conversation only what its spans say does."""
    from tessera.llm import chat

    encode = K.Encoder(K.default_vocabulary())
    texts = {1: "What is it?\nIt is a thing, é.", 2: "no line break", 3: "ends\n", 4: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in K.pack(df).collect()}
    n = lambda t: len(encode([t])[0]) // 4
    assert got[1].loss_tokens == n(texts[1]) + 1 - n("What is it?\n") and got[2].loss_tokens == n(texts[2]) + 1
    assert got[3].loss_tokens == n(texts[3]) + 1 and got[4].loss_tokens == 1
    turns = spark.createDataFrame([(7, 0, "user", "Say < ü"), (7, 1, "assistant", "ü is said."), (7, 2, "user", "Thanks")], "conv_id long, turn int, role string, text string")
    done = chat.format_chat(turns)
    packed = K.pack(done, id_col="conv_id", text="formatted", spans="loss_spans").collect()
    text = done.first().formatted
    a, b = text.index("ü is said."), text.index("ü is said.") + len("ü is said.")
    ids = np.frombuffer(encode([text])[0], "<u4")
    begins = encode.starts(ids)
    inside = sum(len(text[:a].encode()) <= x < len(text[:b].encode()) for x in begins)
    assert [r.loss_tokens for r in packed] == [inside] and inside > 2


def test_uncut_examples_and_loss_limit(spark):
    texts = ["word " * (i % 300) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = K.pack(df, length=512, segments=3, loss=400, least_cut=0).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert all(sum(x.loss_tokens for x in own) <= 400 and len(own) <= 3 and sum(x.length for x in own) <= 512 for own in by.values())


TRICKY = ["", "a", "a  b", "\n", "a\nb c\n\nd", "x \n y", "é b c", "a b", "it's  don't", "tab\tx y", "日本 語\n🤔 x", "\na b", "a b\n", " a", "<|endoftext|> x", "a <|endoftext|> b", "a b <|endoftext|>\n<|endoftext|>  c", "a\x85b c", "a\x1cb c​d", "I'll 12 3,4"]


def test_ids_are_those_of_the_tokenizer():
    encode = K.Encoder(K.default_vocabulary())
    for one, ids in zip(encode(TRICKY), reference(TRICKY)):
        assert np.frombuffer(one, "<u4").tolist() == ids[:-1]


def test_edges(spark):
    """Every row of every kind is packed whole, rows of one id together."""
    rows = K.query(edge.documents(spark)).collect()
    tokens, want = defaultdict(int), defaultdict(int)
    for r in rows:
        tokens[r.doc_id] += r.length
    for (i, text, *_), ids in zip(edge.rows(), reference([t or "" for _, t, *_ in edge.rows()])):
        want[i] += len(ids)
    assert tokens == want and tokens[0] == tokens[1] == 1
    assert K.query(edge.empty(spark)).count() == 0
