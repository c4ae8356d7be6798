"""Rows that try an operator: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

CLASH = ("row", "id", "key", "t", "h", "d", "r", "line", "lines", "size", "doc", "word", "ids", "row2", "k", "maybe", "stays")
TEXTS = [None, "", " \n\t ", "x", "12 34 !!", "one two three four five six seven eight nine ten", "Ünïcödé 語 🤔 \x00 text", "a\n\nb\n", "word " * 20000, "y" * 50000]


def rows():
    out = [(i, t, "en" if i % 2 else None, f"s{i}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    out += [out[5], out[5]]  # repeated rows
    out += [(100, TEXTS[5], "en", None, 1), (None, TEXTS[5], "de", "z", 1), (None, None, None, None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH]) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
