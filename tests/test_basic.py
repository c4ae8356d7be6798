"""The pre-tokenizer with positions and ids, against its expressions."""

import random

from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.operators import pretokenize as P
from tessera.operators.basic import BasicTokenizer
from tessera.operators.tokenize import ids_column, tokens_column
from tessera.schema import Truncation
from tessera.sources.vocab import SpecialTokens, Vocab

SPECIALS = SpecialTokens(unk="[UNK]", cls="[CLS]", mask="<m>", additional=["<m>x"])
WORDS = ["[UNK]", "[CLS]", "<m>", "<m>x", "hello", "world", "!", "語", "[", "]", "cls", "m", "<", ">"]


def vocab():
    return Vocab({w: i for i, w in enumerate(WORDS)}, SPECIALS)


def test_positions_and_ids():
    t = BasicTokenizer(vocab(), lowercase=True, strip_accents=True)
    text = " Héllo\t<m>wörld!語\n[CLS]  ok"
    found = t.tokenize(text)
    assert [x.text for x in found] == ["hello", "<m>", "world", "!", "語", "[", "cls", "]", "ok"]
    assert [text[x.refs[0] : x.refs[-1] + 1] for x in found] == ["Héllo", "<m>", "wörld", "!", "語", "[", "CLS", "]", "ok"]
    assert [int(x.mask) for x in found] == [0, 0, 0, 0, 3, 0, 0, 0, 0]
    assert t.ids(text) == [4, 2, 5, 6, 7, 8, 10, 9, 0] and t.ids(None) == t.ids(" \n") == []


def test_texts_are_those_of_the_expressions(spark):
    rnd = random.Random(2)
    parts = ["Hé", "llo", "[CLS]", "<m>", "x", "!", "語", " ", "\t", "``", "''", "​", "\xa0", "$5", "İ", "🤔", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for lower, strip in ((False, False), (True, True)):
        t = BasicTokenizer(vocab(), lower, strip)
        specials = vocab().special_tokens()
        rows = df.select("k", P.basic_tokenize(F.col("text"), specials, "[UNK]", lower, strip).alias("a"), tokens_column(spark, t)("text").alias("b"), ids_column(spark, t)("text").alias("ids"))
        for r in rows.collect():
            assert [(x.text, x.mask) for x in r.a or []] == list(zip(r.b.tokens, r.b.masks)), texts[r.k]
            assert r.ids == [t.vocab.token_to_id(x) for x in r.b.tokens]


def test_encoding_without_a_template(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("[UNK]\nhello\nworld\n!\n")
    t = BasicTokenizer.from_file(str(path), lowercase=True)
    df = spark.createDataFrame([("Hello world!", "world ?"), ("Hello", None)], "a string, b string")
    one, two = (r.encoded for r in E.encode(df, t, "a", "b", max_len=4, strategy=Truncation.ONLY_FIRST, stride=1).collect())
    assert one.token_ids == [1, 2, 2, 0] and one.segment_ids == [0, 0, 1, 1] and one.special_tokens_mask == [0] * 4 and one.overflowing_tokens == [2, 3]
    assert [(o.begin, o.end) for o in one.token_offsets] == [(0, 5), (6, 11), (0, 5), (6, 7)] and one.reference_offsets[1] == [6, 7, 8, 9, 10]
    assert two.token_ids == [1] and two.segment_ids == [0]
