"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TokenizerError, TokenNotFound
from ..functions import text as T
from ..functions.charclass import BLANK_CLASS, CONTROL_CLASS, CONTROL_LAX_CLASS, DROPPED_CLASS, MARKER, WHITESPACE_CLASS
from ..operators import decode as D
from ..operators import encode as E
from ..operators import kernel
from ..operators import lookup as L
from ..operators import pretokenize as P
from ..operators import segment as S
from ..operators.kernel import Tokenizer
from ..operators.spread import spread
from ..operators.tokenize import explode_tokens, ids_column, mask_name, token_ids_column, tokens_column
from ..schema import Truncation
from ..sources import protowire as W
from ..sources.vocab import SpecialTokens, Vocab
from . import vocabulary as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_made: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer(spark: SparkSession, sf_dir: str):
    """The derived vocabulary as a tokenizer; it is collected once for a session and folder, and has a bounded size."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        for old in [k for k in _made if k[-1] != sf_dir or k[-2] != key[0]]:
            del _made[old]
        _made[key] = V.tokenizer(V.derive(V.word_counts(spark, sf_dir)))
    return _made[key]


def vocab_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, token, is_special) of the derived vocabulary."""
    return tokenizer(spark, sf_dir).vocab.frame(spark)


def pieces_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece, score, idx)."""
    table = tokenizer(spark, sf_dir).pieces.table
    return spark.createDataFrame([(t, float(x[0]), x[1]) for t, x in table.items() if x and x[1] >= 3], "piece string, score float, idx bigint")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct marked words of documents."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.explode(V.words(docs)).alias("word")).distinct()


MARKED = rf"""regexp_extract_all(CASE WHEN starts_with(m, '{MARKER}') THEN m ELSE '{MARKER}' || m END, '{MARKER}[^{MARKER}]*')"""
DOC_WORDS = rf"""
dw AS MATERIALIZED (SELECT doc_id, word, wpos FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS wpos FROM (
         SELECT doc_id, {MARKED} AS ws FROM (SELECT doc_id, regexp_replace(text, '{WHITESPACE_CLASS}', '{MARKER}', 'g') AS m FROM documents WHERE NOT regexp_matches(text, '^{BLANK_CLASS}*$'))))),
words AS MATERIALIZED (SELECT DISTINCT word FROM dw)
"""
ALL_VOCAB = f"""
allv AS (SELECT id, piece AS token, false AS is_special FROM vocab
         UNION ALL SELECT * FROM (VALUES (0, '<s>', true), (1, '<pad>', true), (2, '</s>', true), (3, '<unk>', true)) v(id, token, is_special)
         UNION ALL SELECT max(id) + 1, '<mask>', true FROM vocab)
"""


def text_tokens_sql(source: str, key: str) -> str:
    """CTEs ending in toks (key, pos, token, id, len) for a relation source (key, text) without special tokens."""
    return rf"""
tw AS MATERIALIZED (SELECT {key}, text, unnest(ws) AS word, unnest(range(0, len(ws))) AS wpos FROM (
         SELECT {key}, text, {MARKED} AS ws FROM (SELECT {key}, text, regexp_replace(text, '{WHITESPACE_CLASS}', '{MARKER}', 'g') AS m FROM {source} WHERE NOT regexp_matches(coalesce(text, ''), '^{BLANK_CLASS}*$')))),
words AS MATERIALIZED (SELECT DISTINCT word FROM tw),
{V.path_sql("words")},
toks AS (SELECT tw.{key}, tw.text, row_number() OVER (PARTITION BY tw.{key} ORDER BY wpos, p.pos) - 1 AS pos,
                substring(p.word, p.st + 1, p.en - p.st) AS token, p.idx + 1 AS id, p.en - p.st AS len
         FROM tw JOIN path p USING (word))
"""


# text functions

_CLEANED = f"regexp_replace(regexp_replace(text, '{WHITESPACE_CLASS}', ' ', 'g'), '{DROPPED_CLASS}', '', 'g')"


def _cleaning(key: str, col: str, table: str) -> str:
    cleaned = _CLEANED.replace("text", col)
    return f"""SELECT {key}, CAST(length({col}) - length(regexp_replace({col}, '{WHITESPACE_CLASS}', '', 'g')) AS INT) AS n_whitespace,
       CAST(length({col}) - length(regexp_replace({col}, '{CONTROL_CLASS}', '', 'g')) AS INT) AS n_control,
       CAST(length({col}) - length(regexp_replace({col}, '{CONTROL_LAX_CLASS}', '', 'g')) AS INT) AS n_control_lax,
       md5({cleaned}) AS cleaned, regexp_matches(coalesce({col}, ''), '^{BLANK_CLASS}*$') AS blank FROM {table}"""


def _clean(df: DataFrame, key: str, col: str) -> DataFrame:
    c = F.col(col)
    return df.select(
        key, T.count_whitespace(c).alias("n_whitespace"), T.count_control(c).alias("n_control"), T.count_control(c, strict=False).alias("n_control_lax"),
        F.md5(T.clean_text(c)).alias("cleaned"), T.is_blank(c).alias("blank"),
    )


@query("clean_text", _cleaning("doc_id", "text", "documents"))
def clean_text(spark, sf_dir):
    return _clean(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("clean_pages", _cleaning("page_id", "html", "pages"))
def clean_pages(spark, sf_dir):
    return _clean(read(spark, sf_dir, "pages"), "page_id", "html")


@query("whitespace_to_marker", f"SELECT doc_id, md5(regexp_replace(text, '{WHITESPACE_CLASS}', '{MARKER}', 'g')) AS marked FROM documents")
def whitespace_to_marker(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.whitespace_to_marker(F.col("text"))).alias("marked"))


@query(
    "dummy_prefix",
    f"SELECT doc_id, md5(CASE WHEN starts_with(m, '{MARKER}') THEN m ELSE '{MARKER}' || m END) AS prefixed FROM (SELECT doc_id, regexp_replace(text, '{WHITESPACE_CLASS}', '{MARKER}', 'g') AS m FROM documents)",
)
def dummy_prefix(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.dummy_prefix(T.whitespace_to_marker(F.col("text")))).alias("prefixed"))


@query("lowercase", "SELECT doc_id, md5(lower(text)) AS lowered FROM documents")
def lowercase(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.lowercase(F.col("text"))).alias("lowered"))


@query("strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS stripped FROM documents")
def strip_accents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("stripped"))


# documents hold no compatibility characters, for which NFC is NFKC; nfkc_literals has them
@query("nfkc", "SELECT doc_id, md5(nfc_normalize(text)) AS normalized FROM documents")
def nfkc(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.nfkc(F.col("text"))).alias("normalized"))


#: Texts and their compatibility compositions.
_NFKC = (
    ("plain", "plain"), ("\u2026", "..."), ("\ufb01n", "fin"), ("x\u00b2", "x2"), ("\u00bd", "1\u20442"), ("\uff21\uff22", "AB"), ("e\u0301", "\u00e9"),
    ("\u212b", "\u00c5"), ("\uff76\uff9e", "\u30ac"), ("\u2460", "1"), ("\u1e9b\u0323", "\u1e69"), ("\u00a0", " "), ("\u2122", "TM"), ("\U0001d400", "A"), ("\u3392", "MHz"),
)


@query("nfkc_literals", f"SELECT * FROM (VALUES {', '.join(f"({i}, '{b}')" for i, (_, b) in enumerate(_NFKC))}) v(k, normalized)")
def nfkc_literals(spark, sf_dir):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_NFKC)], "k int, text string")
    return rows.select("k", T.nfkc(F.col("text")).alias("normalized"))


def _replaces(sql: str) -> str:
    for old, new in T.CLEANUP:
        quoted = [x.replace("'", "''") for x in (old, new)]
        sql = f"replace({sql}, '{quoted[0]}', '{quoted[1]}')"
    return sql


_SPACED = r"regexp_replace(text, '([.,!?])', ' \1', 'g')"


@query("cleanup_tokenization", f"SELECT conv_id, turn, md5({_replaces(_SPACED)}) AS tidied FROM conversations")
def cleanup_tokenization(spark, sf_dir):
    spaced = F.regexp_replace("text", "([.,!?])", " $1")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.clean_up_tokenization(spaced)).alias("tidied"))


@query(
    "char_byte_offsets",
    "SELECT item_id, CAST(i AS INT) AS pos, CAST(strlen(left(text, CAST(i AS INT))) AS INT) AS byte_at, substring(text, CAST(i AS INT) + 1, 1) AS char FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark)",
)
def char_byte_offsets(spark, sf_dir):
    each = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.char_byte_offsets(F.col("text"))).alias("pos", "x"))
    return each.select("item_id", "pos", F.col("x.index").alias("byte_at"), F.col("x.char").alias("char"))


@query("utf8_length", "SELECT doc_id, CAST(strlen(text) AS INT) AS n_bytes, CAST(length(text) AS INT) AS n_chars_found FROM documents")
def utf8_length(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.utf8_length(F.col("text")).alias("n_bytes"), F.length("text").alias("n_chars_found"))


@query("substring_chars", "SELECT doc_id, substring(text, 6, 20) AS middle, md5(substring(text, 11)) AS rest FROM documents")
def substring_chars(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.substring_chars(F.col("text"), 5, 20).alias("middle"), F.md5(T.substring_chars(F.col("text"), 10)).alias("rest"))


@query("substring_bytes", "SELECT doc_id, substring(text, 4, 9) AS middle, md5(substring(text, 9)) AS rest FROM documents")
def substring_bytes(spark, sf_dir):
    """Cut at the bytes where the fourth, the ninth and the thirteenth character begin."""
    text = F.col("text")
    at = lambda k: F.octet_length(F.substring(text, 1, k))
    return read(spark, sf_dir, "documents").select("doc_id", T.substring_bytes(text, at(3), at(12)).alias("middle"), F.md5(T.substring_bytes(text, at(8))).alias("rest"))


@query("grapheme_count", "SELECT item_id, CAST(length_grapheme(text) AS INT) AS n_graphemes FROM benchmark")
def grapheme_count(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.grapheme_count("text").alias("n_graphemes"))


# splitting


def _counts(df: DataFrame, tokens) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("whitespace_split", r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r]+')) AS token FROM documents) GROUP BY token")
def whitespace_split(spark, sf_dir):
    return _counts(read(spark, sf_dir, "documents"), P.whitespace_split(F.col("text")))


@query("punct_split", r"SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(token, '^\p{P}$')) AS n_punct, md5(string_agg(token, '|' ORDER BY i)) AS joined FROM (SELECT doc_id, unnest(ts) AS token, unnest(range(0, len(ts))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{P}|[^\p{P}]+') AS ts FROM documents)) GROUP BY doc_id")
def punct_split(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", P.punct_split(F.col("text")).alias("p")).where("size(p) > 0")
    return parts.select("doc_id", F.size("p").cast("long").alias("n"), F.size(F.filter("p", lambda x: x.rlike(r"^\p{P}$"))).cast("long").alias("n_punct"), F.md5(F.array_join("p", "|")).alias("joined"))


@query("cjk_split", r"SELECT doc_id, CAST(len(regexp_extract_all(t, '\p{Lo}|[^\p{Lo}]+')) AS INT) AS n, md5(array_to_string(regexp_extract_all(t, '\p{Lo}|[^\p{Lo}]+'), '|')) AS joined FROM (SELECT doc_id, replace(text, 'the', '語the') AS t FROM documents)")
def cjk_split(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", P.cjk_split(F.replace("text", F.lit("the"), F.lit("語the"))).alias("p"))
    return parts.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("joined"))


@query("basic_tokenize", r"SELECT token, count(*) AS n FROM (SELECT strip_accents(lower(unnest(regexp_extract_all(text, '\p{P}|\p{Lo}|[^ \t\n\r\p{P}\p{Lo}]+')))) AS token FROM documents) GROUP BY token")
def basic_tokenize(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select(P.basic_tokenize(F.col("text"), lower=True, strip=True).alias("t"))
    return _counts(found, F.transform("t", lambda x: x["text"]))


@query(
    "basic_offsets",
    r"""SELECT item_id, token, CAST(e - length(token) AS INT) AS "begin", CAST(e AS INT) AS "end" FROM (SELECT item_id, token, sum(length(token)) OVER (PARTITION BY item_id ORDER BY i) AS e
    FROM (SELECT item_id, unnest(ts) AS token, unnest(range(0, len(ts))) AS i FROM (SELECT item_id, regexp_extract_all(text, '[ \t\n\r]+|\p{P}|\p{Lo}|[^ \t\n\r\p{P}\p{Lo}]+') AS ts FROM benchmark))) WHERE NOT regexp_matches(token, '^[ \t\n\r]')""",
)
def basic_offsets(spark, sf_dir):
    each = read(spark, sf_dir, "benchmark").select("item_id", F.explode(P.basic_offsets(F.col("text"))).alias("x"))
    return each.select("item_id", F.col("x.text").alias("token"), F.col("x.begin").alias("begin"), F.col("x.end").alias("end"))


_INJECTED = "replace(replace(text, ' of ', ' <mask> '), ' la ', ' <unk>')"


@query(
    "special_split",
    rf"""WITH s AS (SELECT doc_id, regexp_extract_all({_INJECTED}, '<unk>|<mask>') AS f, string_split(replace({_INJECTED}, '<unk>', '<mask>'), '<mask>') AS b FROM documents),
e AS (SELECT doc_id, f, unnest(b) AS part, unnest(range(1, len(b) + 1)) AS i, len(b) AS n FROM s),
t AS (SELECT doc_id, i * 2 AS o, CASE WHEN i = n THEN part ELSE regexp_replace(part, '{BLANK_CLASS}+$', '') END AS token, 0 AS mask FROM e
      UNION ALL SELECT doc_id, i * 2 + 1, f[i], CASE WHEN f[i] = '<unk>' THEN 8 ELSE 4 END FROM e WHERE i < n)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE mask = 4) AS n_special, count(*) FILTER (WHERE mask = 8) AS n_unknown, md5(string_agg(token, '|' ORDER BY o)) AS joined FROM t WHERE token <> '' GROUP BY doc_id""",
)
def special_split(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(" of "), F.lit(" <mask> ")), F.lit(" la "), F.lit(" <unk>"))
    parts = read(spark, sf_dir, "documents").select("doc_id", P.split_special(text, ["<unk>", "<mask>"], "<unk>").alias("p")).where("size(p) > 0")
    n = lambda m: F.size(F.filter("p", lambda x: x["mask"] == m)).cast("long")
    return parts.select("doc_id", F.size("p").cast("long").alias("n"), n(4).alias("n_special"), n(8).alias("n_unknown"), F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "|")).alias("joined"))


# vocabulary


@query("vocab_build", f"WITH {V.VOCAB_SQL} SELECT id, piece, score, idx, c FROM vocab")
def vocab_build(spark, sf_dir):
    return V.derive(V.word_counts(spark, sf_dir))


@query("token_to_id", f"WITH {V.VOCAB_SQL}, {ALL_VOCAB} SELECT word, CAST(coalesce(id, 3) AS BIGINT) AS id FROM wc LEFT JOIN allv ON token = word")
def token_to_id(spark, sf_dir):
    rows = V.word_counts(spark, sf_dir).select("word")
    return L.token_to_id(rows, vocab_frame(spark, sf_dir), 3, "word")


@query("id_to_token", f"WITH {V.VOCAB_SQL}, {ALL_VOCAB} SELECT item_id AS k, CAST(item_id * 37 AS BIGINT) AS id, coalesce(token, '<unk>') AS token FROM benchmark LEFT JOIN allv ON id = item_id * 37")
def id_to_token(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), (F.col("item_id") * 37).alias("id"))
    return L.id_to_token(rows, vocab_frame(spark, sf_dir), "<unk>")


@query("special_tokens", f"WITH {V.VOCAB_SQL}, {ALL_VOCAB} SELECT token, CAST(id AS BIGINT) AS id FROM allv WHERE is_special")
def special_tokens(spark, sf_dir):
    return L.special_tokens(vocab_frame(spark, sf_dir))


@query(
    "add_tokens",
    f"""WITH {V.VOCAB_SQL}, {ALL_VOCAB}, t AS (SELECT source AS token, min(doc_id) AS o FROM documents WHERE source IS NOT NULL GROUP BY source),
    n AS (SELECT token, row_number() OVER (ORDER BY o, token) AS k FROM t WHERE token NOT IN (SELECT token FROM allv))
    SELECT CAST(id AS BIGINT) AS id, token, is_special FROM allv UNION ALL SELECT (SELECT max(id) FROM allv) + k, token, false FROM n""",
)
def add_tokens(spark, sf_dir):
    new = read(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("token"), F.col("doc_id").alias("ord"))
    return L.add_tokens(vocab_frame(spark, sf_dir), new)


@query("add_extra_ids", f"WITH {V.VOCAB_SQL}, {ALL_VOCAB} SELECT CAST(id AS BIGINT) AS id, token, is_special FROM allv UNION ALL SELECT (SELECT max(id) FROM allv) + 1 + i, '<extra_id_' || i || '>', false FROM (SELECT unnest(range(0, 100)) AS i)")
def add_extra_ids(spark, sf_dir):
    return L.add_extra_ids(vocab_frame(spark, sf_dir), 100)


# segmentation


@query("prefix_search", f"WITH {V.VOCAB_SQL}, {DOC_WORDS}, e AS (SELECT w.word, st, v.piece, v.idx FROM (SELECT word, st, unnest(range(1, least({V.LONGEST}, length(word) - st) + 1)) AS len FROM (SELECT word, unnest(range(0, length(word))) AS st FROM words)) w JOIN vocab v ON v.piece = substring(word, st + 1, len)) SELECT word, count(*) AS n_edges, CAST(sum(idx) AS BIGINT) AS sum_idx, CAST(max(length(piece)) AS INT) AS longest FROM e GROUP BY word")
def prefix_search(spark, sf_dir):
    edges = S.prefix_search(words(spark, sf_dir), pieces_frame(spark, sf_dir), V.LONGEST)
    return edges.groupBy("word").agg(F.count("*").alias("n_edges"), F.sum("idx").alias("sum_idx"), F.max(F.length("piece")).alias("longest"))


_PATHS = f"WITH RECURSIVE {V.VOCAB_SQL}, {DOC_WORDS}, {V.path_sql('words')} SELECT word, CAST(count(*) AS INT) AS n_pieces, string_agg(substring(word, st + 1, en - st), ' ' ORDER BY pos) AS segmented, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos) AS indices FROM path GROUP BY word"


def _paths(paths: DataFrame) -> DataFrame:
    part = F.transform("path", lambda n: F.substring(F.col("word"), n["st"] + 1, n["en"] - n["st"]))
    return paths.select("word", F.size("path").alias("n_pieces"), F.array_join(part, " ").alias("segmented"), F.array_join(F.transform("path", lambda n: n["idx"].cast("string")), ",").alias("indices"))


@query("best_path_arrow", _PATHS)
def best_path_arrow(spark, sf_dir):
    return _paths(S.best_path_arrow(words(spark, sf_dir), tokenizer(spark, sf_dir).pieces))


@query("best_path_fold", _PATHS)
def best_path_fold(spark, sf_dir):
    found = words(spark, sf_dir)
    return _paths(S.best_path_fold(S.prefix_search(found, pieces_frame(spark, sf_dir), V.LONGEST), found))


_HOLES = "piece NOT IN ('w', 'q', 'u', 'n')"


@query(
    "unknown_merge",
    f"""WITH RECURSIVE {V.VOCAB_SQL}, {DOC_WORDS}, holed AS MATERIALIZED (SELECT * FROM vocab WHERE {_HOLES}), {V.path_sql('words', 'holed')},
    i AS (SELECT *, sum(CASE WHEN idx = 0 AND before = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS island FROM (SELECT *, lag(idx) OVER (PARTITION BY word ORDER BY pos) AS before FROM path)),
    m AS (SELECT word, island, string_agg(substring(word, st + 1, en - st), '' ORDER BY pos) AS token, bool_or(idx = 0) AS unk, count(*) > 1 AS run FROM i GROUP BY word, island)
    SELECT word, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE unk) AS INT) AS n_unknown, CAST(count(*) FILTER (WHERE run) AS INT) AS n_runs, string_agg(token, ' ' ORDER BY island) AS segmented FROM m GROUP BY word""",
)
def unknown_merge(spark, sf_dir):
    holed = {t: x for t, x in tokenizer(spark, sf_dir).pieces.table.items() if t not in ("w", "q", "u", "n")}
    pieces = tokenizer(spark, sf_dir).pieces.__class__([])
    pieces.table = holed | {t: None for t in ("w", "q", "u", "n")}
    tokens = S.merge_unknown(S.path_tokens(S.best_path_arrow(words(spark, sf_dir), pieces)))
    part = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return tokens.groupBy("word").agg(
        F.count("*").cast("int").alias("n"), F.count_if("unknown").cast("int").alias("n_unknown"), F.count_if("run").cast("int").alias("n_runs"), F.array_join(part, " ").alias("segmented")
    )


@query(
    "masks",
    f"""WITH RECURSIVE {V.VOCAB_SQL}, {text_tokens_sql('benchmark', 'item_id')},
    k AS (SELECT *, length(token) = 1 AND regexp_matches(token, '^\\p{{P}}$') AS punct, starts_with(token, '{MARKER}') AS head FROM toks),
    l AS (SELECT *, coalesce(lag(punct) OVER (PARTITION BY item_id ORDER BY pos), false) AS after FROM k)
    SELECT item_id, CAST(pos AS INT) AS pos, token, CASE WHEN punct THEN 'punctuation' WHEN NOT head AND NOT after THEN 'continuation' ELSE 'none' END AS mask FROM l""",
)
def masks(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    tokens = items.select("item_id", tokens_column(spark, tokenizer(spark, sf_dir))("text").alias("t"))
    folded = tokens.select("item_id", F.col("t.tokens").alias("tokens"), S.masks(F.col("t.tokens"), F.transform("t.masks", lambda m: m == 8)).alias("m"))
    each = folded.select("item_id", F.posexplode(F.arrays_zip("tokens", "m")).alias("pos", "x"))
    return each.select("item_id", "pos", F.col("x.tokens").alias("token"), mask_name(F.col("x.m")).alias("mask"))


_DOC_IDS = f"WITH RECURSIVE {V.VOCAB_SQL}, {DOC_WORDS}, {V.path_sql('words')}, ids AS (SELECT word, count(*) AS n, string_agg(CAST(idx + 1 AS VARCHAR), ',' ORDER BY pos) AS ids FROM path GROUP BY word) SELECT doc_id, CAST(sum(n) AS INT) AS n_tokens, md5(string_agg(ids, ',' ORDER BY wpos)) AS ids FROM dw JOIN ids USING (word) GROUP BY doc_id"


def _doc_ids(spark, sf_dir, mode: str) -> DataFrame:
    ids = ids_column(spark, tokenizer(spark, sf_dir), mode)
    rows = read(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids")).where("size(ids) > 0")
    return rows.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids"))


@query("segment_documents", _DOC_IDS)
def segment_documents(spark, sf_dir):
    return _doc_ids(spark, sf_dir, "exact")


@query("segment_documents_by_word", _DOC_IDS)
def segment_documents_by_word(spark, sf_dir):
    return _doc_ids(spark, sf_dir, "word")


@query(
    "tokenize_offsets",
    f"""WITH RECURSIVE {V.VOCAB_SQL}, {text_tokens_sql('benchmark', 'item_id')},
    o AS (SELECT *, sum(len) OVER (PARTITION BY item_id ORDER BY pos) - CASE WHEN regexp_matches(text, '^{WHITESPACE_CLASS}') THEN 0 ELSE 1 END AS e FROM toks)
    SELECT item_id, CAST(pos AS INT) AS pos, token, CAST(greatest(e - len, 0) AS INT) AS "begin", CAST(greatest(e, 1) AS INT) AS "end" FROM o""",
)
def tokenize_offsets(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", tokens_column(spark, tokenizer(spark, sf_dir))("text").alias("t"))
    return explode_tokens(items, "t", "item_id").drop("mask")


# encoding


def _pairs(spark, sf_dir) -> DataFrame:
    """Per conversation and even turn, its text and the next one."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    second = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text2"))
    return turns.where("turn % 2 = 0").join(second, ["conv_id", "turn"], "left").withColumn("k", F.col("conv_id") * 100 + F.col("turn"))


_PAIR_TOKENS = f"""WITH RECURSIVE {V.VOCAB_SQL}, src AS (SELECT conv_id * 100 + turn AS k, text FROM conversations), {text_tokens_sql('src', 'k')},
    ids AS (SELECT k, list(id ORDER BY pos) AS ids FROM toks GROUP BY k),
    pr AS (SELECT a.conv_id * 100 + a.turn AS k, b.text IS NOT NULL AS two, coalesce(x.ids, []) AS a, coalesce(y.ids, []) AS b
           FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
           LEFT JOIN ids x ON x.k = a.conv_id * 100 + a.turn LEFT JOIN ids y ON y.k = b.conv_id * 100 + b.turn WHERE a.turn % 2 = 0),
    n AS (SELECT *, len(a) AS n1, len(b) AS n2, CASE WHEN two THEN 4 ELSE 2 END AS o FROM pr)"""


def _cut_sql(max_len: int, rem1: str, rem2: str, over: str, stride: int) -> str:
    """SQL of an encoding: rem1, rem2 and over are expressions over n1, n2, r, d, run, q, a, b, two."""
    return f"""{_PAIR_TOKENS},
    c AS (SELECT *, greatest(0, n1 + n2 + o - {max_len}) AS r, n1 - n2 AS d FROM n),
    e AS (SELECT *, least(r, abs(d)) AS run, r - least(r, abs(d)) AS q, least(n1, n2) AS m FROM c),
    f AS (SELECT *, CAST({rem1} AS BIGINT) AS g1, CAST({rem2} AS BIGINT) AS g2 FROM e),
    h AS (SELECT *, a[1:n1 - g1] AS ka, b[1:n2 - g2] AS kb FROM f),
    w AS (SELECT *, CASE WHEN len(ka) = 0 OR {stride} = 0 THEN [] ELSE ka[greatest(1, len(ka) - {stride} + 1):len(ka)] END AS wa, CASE WHEN len(kb) = 0 OR {stride} = 0 THEN [] ELSE kb[greatest(1, len(kb) - {stride} + 1):len(kb)] END AS wb FROM h),
    t AS (SELECT k, two, r, CASE WHEN two THEN list_concat(list_concat(list_concat([0], ka), [2, 2]), list_concat(kb, [2])) ELSE list_concat(list_concat([0], ka), [2]) END AS ids,
                 len(ka) AS l1, len(kb) AS l2, CASE WHEN r = 0 THEN [] ELSE {over} END AS over FROM w)
    SELECT k, CAST(len(ids) AS INT) AS n_ids, md5(array_to_string(ids, ',')) AS ids, CAST(CASE WHEN two THEN l2 + 2 ELSE 0 END AS INT) AS n_second,
           CAST(CASE WHEN two THEN 4 ELSE 2 END AS INT) AS n_special, CAST(r AS INT) AS n_truncated, CAST(len(over) AS INT) AS n_over, md5(array_to_string(over, ',')) AS over FROM t"""


def _digest(encoded: DataFrame, offsets: bool = False) -> DataFrame:
    join = lambda c: F.md5(F.array_join(F.transform(c, lambda i: i.cast("string")), ","))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x.cast("int"))
    e = "encoded."
    place = lambda o: F.coalesce(F.concat(o["begin"].cast("string"), F.lit(":"), o["end"].cast("string")), F.lit("-"))
    more = [
        F.md5(F.array_join(F.transform(e + "token_offsets", place), ",")).alias("offsets"), join(F.col(e + "masks")).alias("masks"),
        F.aggregate(e + "reference_offsets", F.lit(0), lambda a, x: a + F.size(x)).alias("n_refs"),
    ]
    return encoded.select(
        "k", F.size(e + "token_ids").alias("n_ids"), join(F.col(e + "token_ids")).alias("ids"), total(F.col(e + "segment_ids")).alias("n_second"), total(F.col(e + "special_tokens_mask")).alias("n_special"),
        F.col(e + "num_truncated_tokens").alias("n_truncated"), F.size(e + "overflowing_tokens").alias("n_over"), join(F.col(e + "overflowing_tokens")).alias("over"),
        *(more if offsets else []),
    )


def _encoded(spark, sf_dir, max_len: int, strategy: Truncation, stride: int = 0) -> DataFrame:
    return _digest(E.encode(_pairs(spark, sf_dir), tokenizer(spark, sf_dir), "text", "text2", max_len, strategy, stride, on_error="null"))


_TURNS = "list_transform(list_reverse(range(0, q)), lambda j: CASE WHEN j % 2 = 0 THEN a[m - j // 2] ELSE b[m - (j - 1) // 2] END)"
_LONGER = "CASE WHEN d > 0 THEN a[n1 - run + 1:n1] ELSE b[n2 - run + 1:n2] END"
_REM1 = "CASE WHEN two THEN (CASE WHEN d > 0 THEN run ELSE 0 END) + (q + 1) // 2 ELSE r END"
_REM2 = "CASE WHEN two THEN (CASE WHEN d < 0 THEN run ELSE 0 END) + q // 2 ELSE 0 END"
_OVER = f"CASE WHEN two THEN list_concat(list_concat(wa, {_TURNS}), {_LONGER}) ELSE list_concat(wa, a[n1 - g1 + 1:n1]) END"


@query("encode_pair", _cut_sql(1_000_000, "0", "0", "[]", 0))
def encode_pair(spark, sf_dir):
    return _encoded(spark, sf_dir, 1_000_000, Truncation.LONGEST_FIRST)


@query("truncate_longest_first", _cut_sql(128, _REM1, _REM2, _OVER, 0))
def truncate_longest_first(spark, sf_dir):
    return _encoded(spark, sf_dir, 128, Truncation.LONGEST_FIRST)


@query(
    "encode_offsets",
    rf"""{_PAIR_TOKENS},
    c AS (SELECT *, greatest(0, n1 + n2 + o - 128) AS r, n1 - n2 AS d FROM n), f AS (SELECT *, least(r, abs(d)) AS run, r - least(r, abs(d)) AS q FROM c),
    h AS (SELECT *, CAST({"CASE WHEN two THEN (CASE WHEN d > 0 THEN run ELSE 0 END) + (q + 1) // 2 ELSE r END"} AS BIGINT) AS g1, CAST({"CASE WHEN two THEN (CASE WHEN d < 0 THEN run ELSE 0 END) + q // 2 ELSE 0 END"} AS BIGINT) AS g2 FROM f),
    z AS (SELECT *, sum(len) OVER w - CASE WHEN regexp_matches(text, '^{WHITESPACE_CLASS}') THEN 0 ELSE 1 END AS e, length(token) = 1 AND regexp_matches(token, '^\p{{P}}$') AS punct,
                 coalesce(lag(length(token) = 1 AND regexp_matches(token, '^\p{{P}}$')) OVER w, false) AS after FROM toks WINDOW w AS (PARTITION BY k ORDER BY pos)),
    l AS (SELECT k, list(greatest(e - len, 0) || ':' || greatest(e, 1) ORDER BY pos) AS offs, list(CASE WHEN punct THEN 2 WHEN NOT starts_with(token, '{MARKER}') AND NOT after THEN 6 ELSE 0 END ORDER BY pos) AS ms,
                 list(len ORDER BY pos) AS ls FROM z GROUP BY k),
    m AS (SELECT h.k, two, coalesce(x.offs, [])[1:n1 - g1] AS oa, coalesce(y.offs, [])[1:n2 - g2] AS ob, coalesce(x.ms, [])[1:n1 - g1] AS ma, coalesce(y.ms, [])[1:n2 - g2] AS mb,
                 coalesce(x.ls, [])[1:n1 - g1] AS la, coalesce(y.ls, [])[1:n2 - g2] AS lb FROM h LEFT JOIN l x ON x.k = h.k LEFT JOIN l y ON y.k = h.k + 1 AND two)
    SELECT k, md5(array_to_string(CASE WHEN two THEN list_concat(list_concat(list_concat(['-'], oa), ['-', '-']), list_concat(ob, ['-'])) ELSE list_concat(list_concat(['-'], oa), ['-']) END, ',')) AS offsets,
           md5(array_to_string(CASE WHEN two THEN list_concat(list_concat(list_concat([4], ma), [4, 4]), list_concat(mb, [4])) ELSE list_concat(list_concat([4], ma), [4]) END, ',')) AS masks,
           CAST(coalesce(list_sum(la), 0) + coalesce(list_sum(lb), 0) AS INT) AS n_refs FROM m""",
)
def encode_offsets(spark, sf_dir):
    """Positions, masks and references of pairs cut to 128 ids."""
    done = E.encode(_pairs(spark, sf_dir), tokenizer(spark, sf_dir), "text", "text2", 128, Truncation.LONGEST_FIRST, on_error="null")
    return _digest(done, offsets=True).select("k", "offsets", "masks", "n_refs")


@query("overflow_stride", _cut_sql(64, _REM1, _REM2, _OVER, 7))
def overflow_stride(spark, sf_dir):
    return _encoded(spark, sf_dir, 64, Truncation.LONGEST_FIRST, 7)


def _one_sided(max_len: int, first: bool, stride: int) -> str:
    """Encodings that cut one sequence only; what cannot be cut gives empty arrays."""
    fails = "n1 < r" if first else "CASE WHEN two THEN n2 < r ELSE r > 0 END"
    gone = ("CASE WHEN fail THEN 0 ELSE r END", "0") if first else ("0", "CASE WHEN fail OR NOT two THEN 0 ELSE r END")
    over = "list_concat(wa, a[n1 - g1 + 1:n1])" if first else "list_concat(wb, b[n2 - g2 + 1:n2])"
    sql = _cut_sql(max_len, *gone, over, stride).replace("r - least(r, abs(d)) AS q,", f"r - least(r, abs(d)) AS q, {fails} AS fail,")
    head, _, tail = sql.rpartition("SELECT k, CAST(len(ids) AS INT)")
    tail = tail.replace(" FROM t", "")
    head = head.replace("t AS (SELECT k, two, r,", "t AS (SELECT k, two, fail, r,")
    cols = ("k", "n_ids", "ids", "n_second", "n_special", "n_truncated", "n_over", "over")
    empty = {c: "md5('')" if c in ("ids", "over") else "0" for c in cols}
    return f"{head}SELECT k, {', '.join(f'CASE WHEN fail THEN {empty[c]} ELSE {c} END AS {c}' for c in cols[1:])} FROM (SELECT fail, k, CAST(len(ids) AS INT){tail} FROM t)"


@query("truncate_only_first", _one_sided(320, True, 5))
def truncate_only_first(spark, sf_dir):
    return _encoded(spark, sf_dir, 320, Truncation.ONLY_FIRST, 5)


@query("truncate_only_second", _one_sided(160, False, 3))
def truncate_only_second(spark, sf_dir):
    return _encoded(spark, sf_dir, 160, Truncation.ONLY_SECOND, 3)


@query(
    "encode_single",
    f"""WITH RECURSIVE {V.VOCAB_SQL}, {text_tokens_sql('benchmark', 'item_id')}, s AS (SELECT item_id, list(id ORDER BY pos) AS ids FROM toks GROUP BY item_id),
    f AS (SELECT item_id, list_concat(list_concat([0], ids), [2]) AS ids FROM s)
    SELECT item_id, CAST(i AS INT) AS pos, CAST(ids[i + 1] AS BIGINT) AS id, 0 AS segment, CASE WHEN i = 0 OR i = len(ids) - 1 THEN 1 ELSE 0 END AS special FROM (SELECT item_id, ids, unnest(range(0, len(ids))) AS i FROM f)""",
)
def encode_single(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    done = E.encode(items, tokenizer(spark, sf_dir), "text", max_len=1_000_000)
    parts = F.arrays_zip(*[F.col(f"encoded.{c}").alias(c) for c in ("token_ids", "segment_ids", "special_tokens_mask")])
    each = done.select("item_id", F.posexplode(parts).alias("pos", "x"))
    return each.select("item_id", "pos", F.col("x.token_ids").alias("id"), F.col("x.segment_ids").cast("int").alias("segment"), F.col("x.special_tokens_mask").cast("int").alias("special"))


@query("do_not_truncate", f"{_PAIR_TOKENS}, c AS (SELECT *, greatest(0, n1 + n2 + o - 160) AS r FROM n) SELECT k, CAST(CASE WHEN r = 0 THEN n1 + n2 + o ELSE 0 END AS INT) AS n_ids, CASE WHEN r = 0 THEN NULL WHEN NOT two AND n1 < r THEN 'Value error: First sequence too short for first only truncation' ELSE 'Value error: Truncation needed but no truncation requested' END AS error FROM c")
def do_not_truncate(spark, sf_dir):
    done = E.encode(_pairs(spark, sf_dir), tokenizer(spark, sf_dir), "text", "text2", 160, Truncation.DO_NOT_TRUNCATE, on_error="null")
    return done.select("k", F.size("encoded.token_ids").alias("n_ids"), F.col("encoded.error").alias("error"))


@query("encode_base", f"{_PAIR_TOKENS} SELECT k, CAST(n1 + n2 AS INT) AS n_ids, md5(array_to_string(list_concat(a, b), ',')) AS ids, CAST(n2 AS INT) AS n_second, 0 AS n_special, 0 AS n_truncated, 0 AS n_over, md5('') AS over FROM n")
def encode_base(spark, sf_dir):
    return _digest(E.encode(_pairs(spark, sf_dir), tokenizer(spark, sf_dir), "text", "text2", 1_000_000, on_error="null", template=E.Template()))


# decoding

_DECODED = f"WITH RECURSIVE {V.VOCAB_SQL}, {text_tokens_sql('benchmark', 'item_id')}"


def _benchmark_ids(spark, sf_dir) -> DataFrame:
    done = E.encode(read(spark, sf_dir, "benchmark").select("item_id", "text"), tokenizer(spark, sf_dir), "text", max_len=1_000_000)
    return done.select("item_id", F.col("encoded.token_ids").alias("ids"))


@query("decode", f"{_DECODED} SELECT item_id, '<s> ' || string_agg(token, ' ' ORDER BY pos) || ' </s>' AS text FROM toks GROUP BY item_id")
def decode(spark, sf_dir):
    return D.decode(_benchmark_ids(spark, sf_dir), tokenizer(spark, sf_dir).vocab).drop("ids")


@query("decode_skip_special", f"{_DECODED} SELECT item_id, {_replaces("string_agg(token, ' ' ORDER BY pos)")} AS text FROM toks GROUP BY item_id")
def decode_skip_special(spark, sf_dir):
    return D.decode(_benchmark_ids(spark, sf_dir), tokenizer(spark, sf_dir).vocab, skip_special=True, clean_up=True).drop("ids")


@query("detokenize", f"SELECT item_id, ' ' || regexp_replace(text, '{WHITESPACE_CLASS}', ' ', 'g') AS text FROM benchmark")
def detokenize(spark, sf_dir):
    tokens = D.ids_to_tokens(_benchmark_ids(spark, sf_dir), tokenizer(spark, sf_dir).vocab, skip_special=True)
    return tokens.select("item_id", D.detokenize(F.col("tokens")).alias("text"))


@query("decode_documents", f"SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^{BLANK_CLASS}*$') THEN '' ELSE CASE WHEN regexp_matches(text, '^{WHITESPACE_CLASS}') THEN '' ELSE ' ' END || regexp_replace(text, '{WHITESPACE_CLASS}', ' ', 'g') END) AS text FROM documents")
def decode_documents(spark, sf_dir):
    """Whole documents to ids and back."""
    known = tokenizer(spark, sf_dir)
    ids = read(spark, sf_dir, "documents").select("doc_id", ids_column(spark, known)("text").alias("ids"))
    return D.ids_to_tokens(ids, known.vocab).select("doc_id", F.md5(D.detokenize(F.col("tokens"))).alias("text"))


@query("array_to_ids", f"WITH {V.VOCAB_SQL}, {ALL_VOCAB}, w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id, {MARKED} AS ws FROM (SELECT doc_id, regexp_replace(text, '{WHITESPACE_CLASS}', '{MARKER}', 'g') AS m FROM documents))) SELECT doc_id, md5(string_agg(CAST(coalesce(id, 3) AS VARCHAR), ',' ORDER BY i)) AS ids FROM w LEFT JOIN allv ON token = word GROUP BY doc_id")
def array_to_ids(spark, sf_dir):
    """Each document's marked words as ids of whole words."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.where("text is not null").select("doc_id", V.words(docs).alias("tokens"))
    return L.array_to_ids(rows, tokenizer(spark, sf_dir).vocab).select("doc_id", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids"))


# files


def _model_file(known, path: str) -> None:
    """The derived pieces as a SentencePiece model file."""
    found = sorted((hit[1], t, hit[0]) for t, hit in known.pieces.table.items() if hit)
    kinds = {0: W.UNKNOWN, 1: W.CONTROL, 2: W.CONTROL}
    with open(path, "wb") as f:
        f.write(W.encode_model([W.Piece(t, score, kinds.get(i, W.NORMAL)) for i, t, score in found]))


_LAYOUTS = """
    SELECT 'flat' AS reader, CAST(id - 4 AS BIGINT) AS id, piece AS token, false AS is_special FROM vocab WHERE id > 4 UNION ALL SELECT 'flat', 0, piece, true FROM vocab WHERE id = 4
    UNION ALL SELECT 'json', CAST(id * 3 AS BIGINT), token, token = '<unk>' FROM allv
    UNION ALL SELECT 'pieces', CAST(id - 1 AS BIGINT), piece, false FROM vocab UNION ALL SELECT * FROM (VALUES ('pieces', 0, '<unk>', true), ('pieces', 1, '<s>', false), ('pieces', 2, '</s>', false)) v
    UNION ALL SELECT 'pair', CAST(id AS BIGINT), token, is_special FROM allv
    UNION ALL SELECT 'mapped', CAST(id - 1 AS BIGINT), piece, false FROM vocab UNION ALL SELECT * FROM (VALUES ('mapped', 0, '[C]', true), ('mapped', 1, '[E]', true), ('mapped', 2, '[U]', true)) v"""


@query("vocab_readers", f"WITH {V.VOCAB_SQL}, {ALL_VOCAB} {_LAYOUTS}")
def vocab_readers(spark, sf_dir):
    """The derived vocabulary written to files of each kind on the driver and read back: flat, JSON, model file, and its two layouts."""
    known = tokenizer(spark, sf_dir)
    pieces = [t for _, t in sorted((hit[1], t) for t, hit in known.pieces.table.items() if hit and hit[1] >= 3)]
    with tempfile.TemporaryDirectory() as at:
        files = {k: os.path.join(at, k) for k in ("flat", "json", "model", "map", "unk")}
        with open(files["flat"], "w", encoding="utf-8") as f:
            f.write("".join(f"{t}\n" for t in pieces))
        with open(files["json"], "w", encoding="utf-8") as f:
            json.dump({t: 3 * i for t, i in known.vocab.values.items()}, f)
        _model_file(known, files["model"])
        with open(files["map"], "w", encoding="utf-8") as f:
            json.dump({"UnkToken": "[U]", "ClsToken": "[C]", "EosToken": "[E]"}, f)
        with open(files["unk"], "w", encoding="utf-8") as f:
            json.dump({"UnkToken": pieces[0]}, f)
        read = {
            "flat": Vocab.from_flat_file(files["flat"], SpecialTokens.from_json(files["unk"])),
            "json": Vocab.from_json(files["json"], SpecialTokens(unk="<unk>")),
            "pieces": Vocab.from_pieces(W.read_model(files["model"]).pieces),
            "pair": Tokenizer.from_file(files["model"]).vocab,
            "mapped": Tokenizer.from_file(files["model"], specials=files["map"]).vocab,
        }
    out = None
    for name, vocab in read.items():
        one = vocab.frame(spark).select(F.lit(name).alias("reader"), "id", "token", "is_special")
        out = one if out is None else out.unionByName(one)
    return out


@query("segment_model_file", f"WITH RECURSIVE {V.VOCAB_SQL}, {text_tokens_sql('benchmark', 'item_id')} SELECT item_id, CAST(count(*) AS INT) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS ids FROM toks GROUP BY item_id")
def segment_model_file(spark, sf_dir):
    """Texts segmented by a tokenizer that was loaded from a model file."""
    with tempfile.TemporaryDirectory() as at:
        _model_file(tokenizer(spark, sf_dir), os.path.join(at, "model"))
        loaded = Tokenizer.from_file(os.path.join(at, "model"))
    rows = read(spark, sf_dir, "benchmark").select("item_id", ids_column(spark, loaded)("text").alias("ids"))
    return rows.select("item_id", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids"))


_LOWER = "(SELECT item_id, lower(text) AS text FROM benchmark) lowered"


@query(
    "tokenize_lowercase",
    f"""WITH RECURSIVE {V.VOCAB_SQL}, {text_tokens_sql(_LOWER, 'item_id')},
    o AS (SELECT *, sum(len) OVER (PARTITION BY item_id ORDER BY pos) - CASE WHEN regexp_matches(text, '^{WHITESPACE_CLASS}') THEN 0 ELSE 1 END AS e FROM toks)
    SELECT item_id, CAST(pos AS INT) AS pos, token, CAST(greatest(e - len, 0) AS INT) AS "begin", CAST(greatest(e, 1) AS INT) AS "end" FROM o""",
)
def tokenize_lowercase(spark, sf_dir):
    """Lower-cased texts with the positions of the texts as they are."""
    known = tokenizer(spark, sf_dir)
    lowered = Tokenizer(known.vocab, known.pieces, lowercase=True)
    items = read(spark, sf_dir, "benchmark").select("item_id", tokens_column(spark, lowered)("text").alias("t"))
    return explode_tokens(items, "t", "item_id").drop("mask")


#: Texts, their compositions, and the positions of their characters: expansions share the first, compositions span what they were made of.
_PLACES = (("ab", "ab", "0 1"), ("\u2026", "...", "0 0 0"), ("e\u0301n", "\u00e9n", "0 2"), ("\ufb01n", "fin", "0 1 1"), ("toke\u0301n", "tok\u00e9n", "0 1 2 3 5"))


@query("nfkc_offsets", f"SELECT * FROM (VALUES {', '.join(f"({i}, '{b}', '{c}')" for i, (_, b, c) in enumerate(_PLACES))}) v(k, normalized, places)")
def nfkc_offsets(spark, sf_dir):
    rows = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(_PLACES)], "k int, text string")

    def run(batches):
        for b in batches:
            found = [kernel.nfkc(t, list(range(len(t)))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([" ".join(map(str, r)) for _, r in found], pa.string())], names=["k", "normalized", "places"])

    return rows.mapInArrow(run, "k int, normalized string, places string")


@query("load_errors", "SELECT * FROM (VALUES ('file', 'File not found error: no-such-file'), ('token', 'Token not found in vocabulary: Unknown token [UNK] not found'), ('value', 'Value error: lengths cannot be negative'), ('base', 'TokenizerError')) v(kind, message)")
def load_errors(spark, sf_dir):
    """What missing files, missing special tokens and bad arguments say."""

    def said(f) -> str:
        try:
            f()
        except TokenizerError as e:
            return str(e)
        return ""

    rows = [
        ("file", said(lambda: Vocab.from_flat_file("no-such-file"))),
        ("token", said(lambda: Vocab({"a": 0}, SpecialTokens()))),
        ("value", said(lambda: E.encode(spark.range(1), None, max_len=-1))),
        ("base", TokenNotFound.__mro__[1].__name__),
    ]
    return spark.createDataFrame(rows, "kind string, message string")


# the pre-tokenizer as a tokenizer


def basic(spark: SparkSession, sf_dir: str):
    """The pre-tokenizer with its derived vocabulary; it is collected once for a session and folder, and has a bounded size."""
    key = ("basic", spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made[key] = V.basic_tokenizer(V.basic_vocab(V.basic_counts(spark, sf_dir)))
    return _made[key]


@query("basic_vocab", f"WITH {V.BASIC_SQL} SELECT id, token, c FROM bvocab")
def basic_vocab(spark, sf_dir):
    return V.basic_vocab(V.basic_counts(spark, sf_dir))


@query("base_encode_documents", f"WITH {V.BASIC_SQL} SELECT doc_id, CAST(count(*) AS INT) AS n_tokens, CAST(count(*) FILTER (WHERE id IS NULL) AS INT) AS n_unknown, md5(string_agg(CAST(coalesce(id, 0) AS VARCHAR), ',' ORDER BY pos)) AS ids FROM btokens LEFT JOIN bvocab USING (token) GROUP BY doc_id")
def base_encode_documents(spark, sf_dir):
    ids = ids_column(spark, basic(spark, sf_dir))
    rows = read(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids")).where("size(ids) > 0")
    return rows.select("doc_id", F.size("ids").alias("n_tokens"), F.size(F.filter("ids", lambda i: i == 0)).alias("n_unknown"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids"))


_MASKED = "replace(replace(text, ' of ', ' x<mask>of '), ' la ', '. <unk>la<mask> ')"


@query(
    "base_tokenize_specials",
    rf"""WITH s AS (SELECT item_id, regexp_extract_all({_MASKED}, '[ \t\n\r]+|<mask>|<unk>|\p{{P}}|\p{{Lo}}|[^ 	

\p{{P}}\p{{Lo}}<]+') AS ts FROM benchmark),
    e AS (SELECT item_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS i FROM s),
    o AS (SELECT *, sum(length(t)) OVER (PARTITION BY item_id ORDER BY i) AS e FROM e)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INT) AS pos, strip_accents(lower(t)) AS token, CAST(e - length(t) AS INT) AS "begin", CAST(e AS INT) AS "end",
           CASE WHEN regexp_matches(t, '^\p{{Lo}}$') THEN 3 ELSE 0 END AS mask FROM o WHERE NOT regexp_matches(t, '^[ \t\n\r]')""",
)
def base_tokenize_specials(spark, sf_dir):
    """Special tokens next to words: cut out, with positions."""
    text = F.replace(F.replace("text", F.lit(" of "), F.lit(" x<mask>of ")), F.lit(" la "), F.lit(". <unk>la<mask> "))
    items = read(spark, sf_dir, "benchmark").select("item_id", tokens_column(spark, basic(spark, sf_dir))(text).alias("t"))
    return explode_tokens(items, "t", "item_id")


_BASE_PAIRS = rf"""WITH {V.BASIC_SQL},
    src AS (SELECT conv_id * 100 + turn AS k, regexp_extract_all(text, '[ \t\n\r]+|\p{{P}}|\p{{Lo}}|[^ 	

\p{{P}}\p{{Lo}}]+') AS ts FROM conversations),
    each AS (SELECT k, unnest(ts) AS t, unnest(range(0, len(ts))) AS i FROM src),
    placed AS (SELECT *, sum(length(t)) OVER (PARTITION BY k ORDER BY i) AS e FROM each),
    ids AS (SELECT k, list(coalesce(id, 0) ORDER BY i) AS ids, list((e - length(t)) || ':' || e ORDER BY i) AS offs FROM placed LEFT JOIN bvocab ON token = strip_accents(lower(t)) WHERE NOT regexp_matches(t, '^[ \t\n\r]') GROUP BY k),
    pr AS (SELECT a.conv_id * 100 + a.turn AS k, coalesce(x.ids, []) AS a, coalesce(y.ids, []) AS b, coalesce(x.offs, []) AS oa, coalesce(y.offs, []) AS ob
           FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
           LEFT JOIN ids x ON x.k = a.conv_id * 100 + a.turn LEFT JOIN ids y ON y.k = b.conv_id * 100 + b.turn WHERE a.turn % 2 = 0),
    n AS (SELECT *, len(a) AS n1, len(b) AS n2, greatest(0, len(a) + len(b) - 64) AS r FROM pr),
    g AS (SELECT *, CASE WHEN n1 < r THEN 0 ELSE r END AS g1, n1 < r AS fail FROM n)
    SELECT k, CAST(CASE WHEN fail THEN 0 ELSE n1 - g1 + n2 END AS INT) AS n_ids, md5(CASE WHEN fail THEN '' ELSE array_to_string(list_concat(a[1:n1 - g1], b), ',') END) AS ids,
           md5(CASE WHEN fail THEN '' ELSE array_to_string(list_concat(oa[1:n1 - g1], ob), ',') END) AS offsets,
           CAST(CASE WHEN fail THEN 0 ELSE n2 END AS INT) AS n_second, CAST(CASE WHEN fail THEN 0 ELSE r END AS INT) AS n_truncated FROM g"""


@query("base_encode_pair", _BASE_PAIRS)
def base_encode_pair(spark, sf_dir):
    """Pairs of turns cut to 64 tokens from the first, without a template."""
    done = E.encode(_pairs(spark, sf_dir), basic(spark, sf_dir), "text", "text2", 64, Truncation.ONLY_FIRST, on_error="null")
    return _digest(done, offsets=True).select("k", "n_ids", "ids", "offsets", "n_second", "n_truncated")


# analytics

_DOC_TOKENS = f"WITH RECURSIVE {V.VOCAB_SQL}, {DOC_WORDS}, {V.path_sql('words')}, dt AS (SELECT d.doc_id, d.lang, substring(p.word, st + 1, en - st) AS token, idx FROM dw JOIN documents d USING (doc_id) JOIN path p USING (word))"


def _doc_tokens(spark, sf_dir, *cols: str) -> DataFrame:
    """One row per token of documents: each distinct word is segmented once and joined to where it stands."""
    docs = read(spark, sf_dir, "documents")
    places = docs.where(~T.is_blank(F.col("text"))).select(*cols, F.explode(V.words(docs)).alias("word")).groupBy(*cols, "word").agg(F.count("*").alias("times"))
    paths = S.path_tokens(S.best_path_arrow(places.select("word").distinct(), tokenizer(spark, sf_dir).pieces))
    return places.join(paths, "word").select(*cols, "token", "times", "unknown")


@query("token_stats_by_lang", f"{_DOC_TOKENS} SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, CAST(sum(length(token)) AS BIGINT) AS n_chars FROM dt GROUP BY lang")
def token_stats_by_lang(spark, sf_dir):
    per = _doc_tokens(spark, sf_dir, "lang").groupBy("lang", "token").agg(F.sum("times").alias("n"))
    return per.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.length("token")).alias("n_chars"))


@query("top_tokens", f"{_DOC_TOKENS} SELECT token, count(*) AS n FROM dt GROUP BY token ORDER BY n DESC, token LIMIT 100")
def top_tokens(spark, sf_dir):
    return _doc_tokens(spark, sf_dir, "lang").groupBy("token").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "token").limit(100)


@query("oov_rate", f"WITH {V.VOCAB_SQL}, {DOC_WORDS} SELECT d.lang, count(*) AS n_words, count(*) FILTER (WHERE v.piece IS NULL) AS n_oov FROM dw JOIN documents d USING (doc_id) LEFT JOIN vocab v ON v.piece = dw.word GROUP BY d.lang")
def oov_rate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    counts = docs.where(~T.is_blank(F.col("text"))).select("lang", F.explode(V.words(docs)).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("times"))
    found = L.token_to_id(counts, vocab_frame(spark, sf_dir), 3)
    return found.groupBy("lang").agg(F.sum("times").alias("n_words"), F.sum(F.when(F.col("id") == 3, F.col("times")).otherwise(0)).alias("n_oov"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
