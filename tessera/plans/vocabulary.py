"""A vocabulary derived from the corpus, in the same way in Spark and in SQL.

Pieces are all characters of marked words (so every text can be segmented) and the ``SIZE`` most
valuable word beginnings and endings, by count times length. Scores are multiples of 1/8 that fall with the rank, so sums
in single precision are exact. Ids: four special tokens, then the pieces by rank, then the mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.charclass import MARKER, WHITESPACE_CLASS
from ..functions.text import SPACES
from ..operators.basic import BasicTokenizer
from ..operators.kernel import Pieces, Tokenizer
from ..operators.pretokenize import basic_tokenize
from ..operators.segment import marked_words
from ..operators.spread import spread
from ..sources.vocab import SpecialTokens, Vocab

SIZE = 4000
LONGEST = 8
ENDING = 4
SPECIALS = SpecialTokens(unk="<unk>", pad="<pad>", bos="<s>", sep="</s>", cls="<s>", eos="</s>", mask="<mask>")
TEXTS = ("documents", "benchmark", "conversations")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in TEXTS:
        one = spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select("text"))
        out = one if out is None else out.unionByName(one)
    return out


def words(df: DataFrame, text: str = "text"):
    """The marked words of a text column, white space being a marker each."""
    return marked_words(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, " " * len(SPACES)))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, c) over all texts."""
    df = texts(spark, sf_dir)
    return df.select(F.explode(words(df)).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def derive(counts: DataFrame) -> DataFrame:
    """(id, piece, score, idx, c): at most SIZE pieces and the characters, so the ranking is a small sort in one task."""
    n = F.length("word")
    chars = counts.select(F.explode(F.split("word", "")).alias("piece"), "c").where("piece <> ''")
    heads = counts.where(n >= 2).select(F.explode(F.transform(F.sequence(F.lit(2), F.least(n, F.lit(LONGEST))), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("piece"), "c")
    tails = counts.where(n >= 3).select(F.explode(F.transform(F.sequence(F.lit(2), F.least(n - 1, F.lit(ENDING))), lambda k: F.substring(F.col("word"), n - k + 1, k))).alias("piece"), "c")
    total = chars.unionByName(heads).unionByName(tails).groupBy("piece").agg(F.sum("c").alias("c"))
    worth = total.withColumn("worth", F.col("c") * F.length("piece"))
    best = worth.where(F.length("piece") > 1).orderBy(F.desc("worth"), "piece").limit(SIZE).unionByName(worth.where(F.length("piece") == 1))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("worth"), "piece")) - 1)
    score = -(F.lit(1.0) + F.floor(F.col("rank") / 64) * F.lit(0.125))
    return ranked.select((F.col("rank") + 4).cast("bigint").alias("id"), "piece", score.cast("float").alias("score"), (F.col("rank") + 3).cast("bigint").alias("idx"), "c")


def tokenizer(pieces: DataFrame) -> Tokenizer:
    """The pieces, a bounded number, as a tokenizer."""
    rows = pieces.select("piece", "score").orderBy("id").collect()
    values = {t: i for i, t in enumerate(("<s>", "<pad>", "</s>", "<unk>"))}
    values |= {r.piece: i + 4 for i, r in enumerate(rows)}
    values["<mask>"] = len(values)
    return Tokenizer(Vocab(values, SPECIALS), Pieces([("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *[(r.piece, r.score) for r in rows]]))


#: Words of the pre-tokenizer's vocabulary, and its special tokens, which have the first ids.
BASIC_SIZE = 3000
BASIC_SPECIALS = SpecialTokens(unk="<unk>", pad="<pad>", bos="<s>", sep="</s>", cls="<s>", eos="</s>", mask="<mask>")


def basic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, c) of the pre-tokenizer over documents, in lower case without accents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = docs.select(F.explode(basic_tokenize(F.col("text"), lower=True, strip=True)).alias("t"))
    return found.groupBy(F.col("t.text").alias("token")).agg(F.count("*").alias("c"))


def basic_vocab(counts: DataFrame) -> DataFrame:
    """(id, token, c): the BASIC_SIZE commonest tokens after the special ones."""
    best = counts.orderBy(F.desc("c"), "token").limit(BASIC_SIZE)
    rank = F.row_number().over(Window.orderBy(F.desc("c"), "token"))
    return best.select((rank + 4).cast("bigint").alias("id"), "token", "c")


def basic_tokenizer(vocab: DataFrame) -> BasicTokenizer:
    """The vocabulary, a bounded number of rows, as a tokenizer."""
    values = {t: i for i, t in enumerate(("<unk>", "<pad>", "<s>", "</s>", "<mask>"))}
    values |= {r.token: r.id for r in vocab.select("id", "token").collect()}
    return BasicTokenizer(Vocab(values, BASIC_SPECIALS), lowercase=True, strip_accents=True)


#: The same in SQL: bvocab (id, token, c).
BASIC_TOKENS = r"regexp_extract_all(text, '\p{P}|\p{Lo}|[^ \t\n\r\p{P}\p{Lo}]+')"
BASIC_SQL = rf"""
btokens AS (SELECT doc_id, strip_accents(lower(unnest(ts))) AS token, unnest(range(0, len(ts))) AS pos FROM (SELECT doc_id, {BASIC_TOKENS} AS ts FROM documents)),
bvocab AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY c DESC, token) + 4 AS BIGINT) AS id, token, c
                        FROM (SELECT token, count(*) AS c FROM btokens GROUP BY token ORDER BY c DESC, token LIMIT {BASIC_SIZE}))
"""


#: The same in SQL: wc (word, c) and vocab (id, piece, score, idx, c).
VOCAB_SQL = rf"""
texts AS (SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations),
wc AS MATERIALIZED (SELECT word, count(*) AS c FROM (
         SELECT unnest(regexp_extract_all(CASE WHEN starts_with(m, '{MARKER}') THEN m ELSE '{MARKER}' || m END, '{MARKER}[^{MARKER}]*')) AS word
         FROM (SELECT regexp_replace(coalesce(text, ''), '{WHITESPACE_CLASS}', '{MARKER}', 'g') AS m FROM texts)) GROUP BY word),
cand AS (SELECT piece, CAST(sum(c) AS BIGINT) AS c FROM (
           SELECT substring(word, i, 1) AS piece, c FROM (SELECT word, c, unnest(range(1, length(word) + 1)) AS i FROM wc)
           UNION ALL SELECT substring(word, 1, i), c FROM (SELECT word, c, unnest(range(2, least(length(word), {LONGEST}) + 1)) AS i FROM wc)
           UNION ALL SELECT right(word, i), c FROM (SELECT word, c, unnest(range(2, least(length(word) - 1, {ENDING}) + 1)) AS i FROM wc)) GROUP BY piece),
worth AS (SELECT piece, c, c * length(piece) AS worth FROM cand),
best AS (SELECT * FROM (SELECT * FROM worth WHERE length(piece) > 1 ORDER BY worth DESC, piece LIMIT {SIZE}) UNION ALL SELECT * FROM worth WHERE length(piece) = 1),
ranked AS (SELECT piece, c, row_number() OVER (ORDER BY worth DESC, piece) - 1 AS rank FROM best),
vocab AS MATERIALIZED (SELECT CAST(rank + 4 AS BIGINT) AS id, piece, CAST(-(1.0 + floor(rank / 64) * 0.125) AS FLOAT) AS score, CAST(rank + 3 AS BIGINT) AS idx, c FROM ranked)
"""


def path_sql(words: str, vocab: str = "vocab", name: str = "path") -> str:
    """CTEs that end in ``name`` (word, st, en, idx, pos): the best path of each word of the relation ``words`` (word)."""
    return rf"""
edges_{name} AS (SELECT w.word, w.st, w.st + w.len AS en, v.score, v.idx
   FROM (SELECT word, st, unnest(range(1, least({LONGEST}, length(word) - st) + 1)) AS len FROM (SELECT word, unnest(range(0, length(word))) AS st FROM {words})) w
   JOIN {vocab} v ON v.piece = substring(w.word, w.st + 1, w.len)),
ends_{name} AS MATERIALIZED (SELECT word, en, list(struct_pack(st := st, score := score, idx := idx)) AS es FROM edges_{name} GROUP BY word, en),
walk_{name} AS (
   SELECT word, CAST(0 AS BIGINT) AS k, [CAST(0 AS FLOAT)] AS sc, [CAST(-1 AS BIGINT)] AS bk, [CAST(0 AS BIGINT)] AS ix FROM {words}
   UNION ALL
   SELECT word, k + 1, list_append(sc, coalesce(b.s, CAST(0 AS FLOAT))), list_append(bk, coalesce(-b.m, k)), list_append(ix, coalesce(b.x, 0))
   FROM (SELECT w.word, w.k, w.sc, w.bk, w.ix,
                list_max(list_transform(e.es, lambda x: struct_pack(s := CAST(w.sc[x.st + 1] + x.score AS FLOAT), m := -x.st, x := x.idx))) AS b
         FROM walk_{name} w LEFT JOIN ends_{name} e ON e.word = w.word AND e.en = w.k + 1 WHERE w.k < length(w.word))),
done_{name} AS MATERIALIZED (SELECT * FROM walk_{name} WHERE k = length(word)),
trace_{name} AS (
   SELECT word, bk, ix, length(word) AS en, bk[length(word) + 1] AS st FROM done_{name} WHERE length(word) > 0
   UNION ALL SELECT word, bk, ix, st, bk[st + 1] FROM trace_{name} WHERE st > 0),
{name} AS MATERIALIZED (SELECT word, CAST(st AS INT) AS st, CAST(en AS INT) AS en, ix[en + 1] AS idx, CAST(row_number() OVER (PARTITION BY word ORDER BY en) - 1 AS INT) AS pos FROM trace_{name})
"""
