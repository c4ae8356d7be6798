"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and a bitmask of failed
rules. A policy is a versioned mask over these bits, so policies are applied, compared and ablated by
bitwise operations on the ledger without reading a text again. Built-in expressions only; nothing is
shuffled but the grouped masks of ``ablation``.

Null and empty texts have no words and fail ``few_words``. Rows are judged one by one, so ties, repeated
rows and null ids change nothing. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 3

#: Rule -> failure condition over the measurements. The position is the bit; rules are only ever appended.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "capitals": "100 * n_upper > 40 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policy version -> mask of the rules that reject.
POLICIES = {"v1": BASE, "v2": sum(BIT.values())}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once for the row."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more: sort (hash, position), keep runs, add up gaps."""
    windows = bound(
        words,
        lambda w: F.slice(
            F.transform(w, lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("i"))),
            1,
            F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)),
        ),
    )
    places = bound(
        F.sort_array(windows),
        lambda s: F.transform(
            F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]
        ),
    )
    return F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def ledger(docs: DataFrame, text: str = "text", version: str = CURRENT) -> DataFrame:
    """All columns of docs in ``row`` (a struct, so no name can clash), the measurements, fail_bits, base_failed, kept."""
    base = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = base.select(
        "row",
        "t",
        F.array_remove(F.split("t", SPACES), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    count = lambda c: c.cast("long")
    measured = split.select(
        "row",
        count(F.size("w")).alias("n_words"),
        count(F.length(F.array_join("w", ""))).alias("word_chars"),
        count(F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).alias("n_symbols"),
        count(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        count(_repeated(F.col("w"))).alias("n_repeat_words"),
        count(F.size("l")).alias("n_lines"),
        count(F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).alias("n_upper"),
    )
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return apply_policy(measured.select("row", *MEASURES, bits.cast("long").alias("fail_bits")), version)


def apply_policy(ledger_rows: DataFrame, version: str) -> DataFrame:
    """The verdict of a policy on a ledger: base_failed, policy, kept."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return ledger_rows.drop("base_failed", "policy", "kept").select(
        "*", failed(BASE).alias("base_failed"), F.lit(version).alias("policy"), (~failed(BASE | POLICIES[version])).alias("kept")
    )


def ablation(ledger_rows: DataFrame, versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: documents the rule fails, those only it rejects, and the rejects left without it.

    The ledger is first counted by fail_bits (at most 2**rules groups, combined before the shuffle).
    """
    counts = ledger_rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [(v, POLICIES[v], name, BIT[name]) for v in versions for name in RULES if POLICIES[v] & BIT[name]]
    cell = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).alias("mask"), F.lit(r).alias("rule"), F.lit(b).alias("bit")) for v, m, r, b in cases]))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    return (
        counts.select("fail_bits", "n", cell.alias("c"))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            total(hit.bitwiseAND(F.col("c.bit")) != 0)("fails"),
            total(hit == F.col("c.bit"))("only_this"),
            total(hit.bitwiseAND(F.bitwise_not("c.bit")) != 0)("rejected_without"),
        )
    )


def keep(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents the policy keeps, with their own columns."""
    return ledger(docs, version=version).where("kept").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """The digest of the ledger that op1 returns."""
    return ledger(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        *MEASURES[:5],
        "base_failed",
        "kept",
        "n_lines",
        "n_upper",
        "fail_bits",
    )


def ablation_query(docs: DataFrame) -> DataFrame:
    """The ablation of all policies over a table of documents."""
    return ablation(ledger(docs.select("doc_id", "text")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT rid, i, w, lead(w, 1) OVER q AS w2, lead(w, 2) OVER q AS w3 FROM p WINDOW q AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
             + 8 * (100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT
             + 64 * (100 * n_upper > 40 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_upper, fail_bits FROM b
"""

_CASES = ", ".join(f"('{v}', {mask}, '{name}', {BIT[name]})" for v, mask in POLICIES.items() for name in RULES if mask & BIT[name])
ABLATION_SQL = f"""{SQL[: SQL.rindex("SELECT doc_id")]}
SELECT policy, rule, CAST(count(*) FILTER (WHERE fail_bits & bit <> 0) AS BIGINT) AS fails, CAST(count(*) FILTER (WHERE fail_bits & mask = bit) AS BIGINT) AS only_this,
       CAST(count(*) FILTER (WHERE fail_bits & mask & ~bit <> 0) AS BIGINT) AS rejected_without
FROM b, (VALUES {_CASES}) c(policy, mask, rule, bit) GROUP BY policy, rule
"""
