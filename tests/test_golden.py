"""Known encodings of short texts: ids and positions."""

import pytest
from mini import tokenizer

from tessera.operators import encode as E
from tessera.schema import Truncation

# Known texts, ids and positions, which must match.
GOLDEN = [
    ("…", [0, 153, 2], [(0, 1)]),
    ("This is a sample sentence to be tokénized", [0, 3293, 83, 10, 121413, 149357, 47, 186, 25636, 2746, 29367, 2], [(0, 4), (4, 7), (7, 9), (9, 16), (16, 25), (25, 28), (28, 31), (31, 35), (35, 38), (38, 42)]),
    ("tokénized", [0, 25636, 2746, 29367, 2], [(0, 3), (3, 6), (6, 10)]),
    ("Wondering how this will get tokenized 🤔 ?", [0, 76648, 214, 3642, 903, 1221, 2046, 47, 1098, 29367, 6, 243691, 705, 2], [(0, 6), (6, 9), (9, 13), (13, 18), (18, 23), (23, 27), (27, 30), (30, 33), (33, 37), (37, 38), (38, 39), (39, 41)]),
    ("hi 🤔", [0, 1274, 6, 243691, 2], [(0, 2), (2, 3), (3, 4)]),
    (" 🤔 ?", [0, 6, 243691, 705, 2], [(0, 1), (1, 2), (2, 4)]),
    ("İs th!s 𩸽 Ϻ Šœ Ugljšić dấu nặng", [0, 63770, 5675, 38, 7, 6, 3, 6, 3, 3608, 52908, 345, 11016, 170, 36277, 39973, 55315, 2], [(0, 2), (2, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11)]),
    ("İs th!s", [0, 63770, 5675, 38, 7, 2], [(0, 2), (2, 5), (5, 6), (6, 7)]),
    ("   İs th!s    𩸽 Ϻ Šœ   Ugljšić  dấu nặng     ", [0, 6, 6, 63770, 5675, 38, 7, 6, 6, 6, 6, 3, 6, 3, 3608, 52908, 6, 6, 345, 11016, 170, 36277, 6, 39973, 55315, 6, 6, 6, 6, 6, 2], [(0, 1), (1, 2), (2, 5), (5, 8), (8, 9), (9, 10)]),
    (" � İs th!s �� 𩸽 Ϻ Šœ   Ugljšić  dấu nặng     ", [0, 6, 63770, 5675, 38, 7, 6, 6, 3, 6, 3, 3608, 52908, 6, 6, 345, 11016, 170, 36277, 6, 39973, 55315, 6, 6, 6, 6, 6, 2], [(0, 1), (2, 5), (5, 8), (8, 9), (9, 10), (10, 11), (13, 14)]),
    ("´", [0, 3309, 2], [(0, 1)]),
]


@pytest.fixture(scope="module")
def encoded(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "k int, text string")
    return {r.k: r.encoded for r in E.encode(rows, tokenizer(), "text").collect()}


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_ids_and_offsets(encoded, k):
    _, ids, offsets = GOLDEN[k]
    assert encoded[k].token_ids == ids
    found = [(o.begin, o.end) if o else None for o in encoded[k].token_offsets]
    assert found[0] is None and found[-1] is None and len(found) == len(ids)
    assert found[1 : 1 + len(offsets)] == offsets


def test_truncation_keeps_the_template(spark):
    rows = spark.createDataFrame([("Wondering how this will get tokenized 🤔 ?",)], "text string")
    r = E.encode(rows, tokenizer(), "text", max_len=5, strategy=Truncation.ONLY_FIRST).first().encoded
    assert r.token_ids == [0, 76648, 214, 3642, 2]
    assert r.num_truncated_tokens == len(r.overflowing_tokens) == 9


def test_pairs_and_empty_second_text(spark):
    rows = spark.createDataFrame([(0, "hi", None), (1, "hi", ""), (2, "hi", "this is"), (3, None, None), (4, " \t ", "hi")], "k int, a string, b string")
    got = {r.k: r.encoded for r in E.encode(rows, tokenizer(), "a", "b").collect()}
    assert got[0].token_ids == [0, 1274, 2] and got[0].segment_ids == [0, 0, 0] and got[0].special_tokens_mask == [1, 0, 1]
    assert got[1].token_ids == [0, 1274, 2, 2, 2] and got[1].segment_ids == [0, 0, 0, 1, 1]
    assert got[2].token_ids == [0, 1274, 2, 2, 903, 83, 2] and got[2].segment_ids == [0, 0, 0, 1, 1, 1, 1]
    assert got[2].special_tokens_mask == [1, 0, 1, 1, 0, 0, 1]
    assert got[3].token_ids == [0, 2] and got[4].token_ids == [0, 2, 2, 1274, 2]


def test_special_tokens_in_text(spark):
    t = tokenizer()
    assert [x.text for x in t.tokenize("dấu <mask> hi")] == ["▁dấu", "<mask>", "▁hi"]
    assert [int(x.mask) for x in t.tokenize("dấu <mask> hi")] == [0, 4, 0]
    assert [x.refs for x in t.tokenize("é<mask>")][-1] == [1, 2, 3, 4, 5, 6]
    assert t.ids("<unk>") == [3] and int(t.tokenize("<unk>")[0].mask) == 8


def test_base_template(spark):
    rows = spark.createDataFrame([("hi", "this")], "a string, b string")
    r = E.encode(rows, tokenizer(), "a", "b", template=E.Template()).first().encoded
    assert r.token_ids == [1274, 903] and r.segment_ids == [0, 1] and r.special_tokens_mask == [0, 0]


def test_lowercase_keeps_astral(spark):
    t = tokenizer(lowercase=True)
    assert [x.text for x in t.tokenize("HI 🤔🤔")] == ["▁hi", "▁", "🤔", "🤔"]
