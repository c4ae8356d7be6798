"""Text functions and splitting on rows made to try them."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import pretokenize as P


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_cleaning(spark):
    assert one(spark, "a\tb c​d\x00e�f\u0085", T.clean_text) == "a b cdef"
    assert one(spark, None, T.clean_text) is None
    assert one(spark, "a­b", lambda c: T.count_control(c)) == 1 and one(spark, "a­b", lambda c: T.count_control(c, False)) == 0
    for blank in (None, "", "  \n"):
        assert one(spark, blank, T.is_blank)
    assert one(spark, "▁x", T.dummy_prefix) == "▁x" and one(spark, "x", T.dummy_prefix) == "▁x"
    assert one(spark, "a  b", T.whitespace_to_marker) == "a▁▁b"


def test_normalization(spark):
    assert one(spark, "ﬁ…é", T.nfkc) == "fi...é"
    assert one(spark, "Éàñç Ж", T.strip_accents) == "Eanc Ж"
    assert one(spark, "``x''​", T.clean_word) == '"x"'
    assert one(spark, "it 's . do not ! we 've", T.clean_up_tokenization) == "it's. don't! we've"
    df = spark.createDataFrame([(1, "a"), (2, "é"), (3, None)], "k int, t string")
    assert {r.k: r.o for r in df.select("k", T.strip_accents(F.col("t")).alias("o")).collect()} == {1: "a", 2: "e", 3: None}
    assert {r.k: r.o for r in df.where("k <> 2").select("k", T.nfkc(F.col("t")).alias("o")).collect()} == {1: "a", 3: None}


def test_positions(spark):
    for text in ("…", "tokénized", " 🤔 ?", ""):
        got = [x["index"] for x in one(spark, text, T.char_byte_offsets)]
        assert got == [len(text[:i].encode()) for i in range(len(text))]
    assert one(spark, "aébc", lambda c: T.substring_bytes(c, 2, 4)) == "�b" and one(spark, "aé", lambda c: T.substring_bytes(c, 9, 4)) == ""
    assert one(spark, "aébc", lambda c: T.substring_bytes(c, 1, 3)) == "é" and one(spark, "aébc", lambda c: T.substring_bytes(c, 3)) == "bc"
    assert one(spark, "a🤔bc", lambda c: T.substring_chars(c, 1, 2)) == "🤔b"
    assert one(spark, "é🤔", T.grapheme_count) == 2


def test_splits(spark):
    assert one(spark, " a\tb \n", P.whitespace_split) == ["a", "b"]
    assert one(spark, "a!b$", P.punct_split) == ["a", "!", "b$"]
    assert one(spark, "ab語c", P.cjk_split) == ["ab", "語", "c"]
    found = one(spark, "Héllo [CLS] 語!", lambda c: P.basic_tokenize(c, ["[CLS]"], lower=True, strip=True))
    assert [(x.text, x.mask) for x in found] == [("hello", 0), ("[", 0), ("cls", 0), ("]", 0), ("語", 3), ("!", 0)]
    assert [(x.text, x.begin, x.end) for x in one(spark, " a b!", P.basic_offsets)] == [("a", 1, 2), ("b", 3, 4), ("!", 4, 5)]


def test_special_split(spark):
    split = lambda t: [(x.text, x.mask) for x in one(spark, t, lambda c: P.split_special(c, ["<u>", "<m>", "<m>x"], "<u>"))]
    assert split("é \t<m> b") == [("é", 0), ("<m>", 4), (" b", 0)]
    assert split("<u><m>x") == [("<u>", 8), ("<m>", 4), ("x", 0)]
    assert split("a ") == [("a ", 0)] and split("") == []
