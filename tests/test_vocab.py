"""Vocabularies and their readers."""

import json

import pytest

from tessera.operators.basic import BasicTokenizer
from tessera.operators.kernel import Pieces, Tokenizer
from tessera.protocols import TokenizerProtocol, VocabProtocol
from tessera import errors
from tessera.operators import lookup as L
from tessera.sources import protowire as W
from tessera.sources.vocab import SpecialTokens, Vocab


def write(tmp_path, text, name="v"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_flat_file(tmp_path):
    v = Vocab.from_flat_file(write(tmp_path, "hello\nworld\n[UNK]\n!"))
    assert v.values == {"hello": 0, "world": 1, "[UNK]": 2, "!": 3} and v.special_values == {"[UNK]": 2}
    assert v.tokens_to_ids(["hello", "oov_value", "!"]) == [0, 2, 3]
    assert [v.id_to_token(i) for i in (0, 2, 9)] == ["hello", "[UNK]", "[UNK]"]


def test_missing_unknown_token(tmp_path):
    with pytest.raises(errors.TokenNotFound, match=r"Unknown token \[UNK\] not found"):
        Vocab.from_flat_file(write(tmp_path, "hello\nworld\n!"))


def test_missing_and_duplicate(tmp_path):
    for read in (Vocab.from_flat_file, Vocab.from_json, Vocab.from_sentencepiece, SpecialTokens.from_json):
        with pytest.raises(errors.TokenizerFileNotFound):
            read(str(tmp_path / "none"))
    with pytest.raises(errors.VocabularyParsingError):
        Vocab.from_flat_file(write(tmp_path, "a\na\n[UNK]"))


def test_json_and_special_map(tmp_path):
    path = write(tmp_path, json.dumps({"a": 5, "<u>": 7, "<m>": 9}))
    for keys in ({"UnkToken": "<u>", "AdditionalSpecialTokens": ["<m>"]}, {"unk_token": "<u>", "additional_special_tokens": ["<m>"]}):
        specials = SpecialTokens.from_json(write(tmp_path, json.dumps(keys), "s"))
        v = Vocab.from_json(path, specials)
        assert v.special_tokens() == ["<u>", "<m>"] and v.unk_id == 7
    assert v.default("pad") == "<pad>" and v.default("sep") == "</s>"


def test_growth():
    v = Vocab({"[UNK]": 0, "a": 3}, SpecialTokens())
    v.add_tokens(["b", "a", "c", "b"])
    assert (v.values["b"], v.values["c"]) == (4, 5)
    v.add_extra_ids(2)
    assert v.id_to_token(7) == "<extra_id_1>"
    v.add_extra_ids(1)
    assert v.values["<extra_id_0>"] == 8 and v.id_to_token(6) == "<extra_id_0>"
    empty = Vocab({"[UNK]": 0}, SpecialTokens())
    empty.values.clear()
    empty.add_tokens(["x"])
    assert empty.values == {"x": 1}


def test_model_file(tmp_path):
    pieces = [W.Piece("<unk>", 0.0, W.UNKNOWN), W.Piece("<s>", 0.0, W.CONTROL), W.Piece("</s>", 0.0, W.CONTROL), W.Piece("▁a", -1.5), W.Piece("é", -2.25, W.USER_DEFINED)]
    path = tmp_path / "m"
    path.write_bytes(W.encode_model(pieces))
    assert W.read_model(str(path)).pieces == pieces
    v = Vocab.from_sentencepiece(str(path))
    assert v.values == {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "▁a": 4, "é": 5, "<mask>": 6}
    with pytest.raises(errors.VocabularyParsingError):
        W.parse_model(W.encode_model(pieces)[:-3] + b"\x0a\xff")


def test_model_file_with_mapped_specials(tmp_path):
    """Special tokens that the map leaves out are not put in; one that is no piece and not put in cannot be registered."""
    pieces = [W.Piece("<unk>"), W.Piece("<s>"), W.Piece("</s>"), W.Piece("▁a", -1.5), W.Piece("[X]", -2.0)]
    model, mapped = tmp_path / "m", tmp_path / "s.json"
    model.write_bytes(W.encode_model(pieces))
    mapped.write_text('{"UnkToken": "[U]", "ClsToken": "[C]", "EosToken": "[E]", "AdditionalSpecialTokens": ["[X]"]}')
    v = Vocab.from_sentencepiece(str(model), SpecialTokens.from_json(str(mapped)))
    assert v.values == {"[C]": 0, "[E]": 1, "[U]": 2, "▁a": 3, "[X]": 4} and v.special_tokens() == ["[U]", "[C]", "[E]", "[X]"]
    t = Tokenizer.from_file(str(model), specials=str(mapped))
    assert t.ids("a[X] zz") == [3, 4, 2] and t.vocab.default("pad") == "<pad>"
    mapped.write_text('{"UnkToken": "[U]", "BosToken": "[B]"}')
    with pytest.raises(errors.TokenNotFound):
        Vocab.from_sentencepiece(str(model), SpecialTokens.from_json(str(mapped)))


def test_protocols():
    v = Vocab({"[UNK]": 0, "a": 1}, SpecialTokens())
    assert isinstance(v, VocabProtocol) and isinstance(BasicTokenizer(v), TokenizerProtocol)
    assert isinstance(Tokenizer(v, Pieces([("[UNK]", 0.0)])), TokenizerProtocol) and not isinstance(object(), TokenizerProtocol)


def test_joins(spark):
    v = Vocab({"[UNK]": 0, "a": 1, "b": 2}, SpecialTokens())
    frame = v.frame(spark)
    rows = spark.createDataFrame([("a",), ("zz",), (None,)], "token string")
    assert sorted(((r.token or ""), r.id) for r in L.token_to_id(rows, frame, 0).collect()) == [("", 0), ("a", 1), ("zz", 0)]
    ids = spark.createDataFrame([(2,), (77,)], "id bigint")
    assert sorted(r.token for r in L.id_to_token(ids, frame, "[UNK]").collect()) == ["[UNK]", "b"]
    arrays = spark.createDataFrame([(0, ["b", "a", "x", None]), (1, []), (2, None)], "k int, tokens array<string>")
    assert {r.k: r.ids for r in L.array_to_ids(arrays, v).collect()} == {0: [2, 1, 0, 0], 1: [], 2: []}
    new = spark.createDataFrame([("c", 2), ("b", 1), ("d", 1), ("c", 0)], "token string, ord int")
    assert {r.token: r.id for r in L.add_tokens(frame, new).collect()} == {"[UNK]": 0, "a": 1, "b": 2, "c": 3, "d": 4}
    assert L.add_extra_ids(frame, 3).count() == 6 and L.special_tokens(frame).count() == 1
