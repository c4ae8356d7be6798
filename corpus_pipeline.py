"""A corpus pipeline: documents -> language -> quality -> lines -> near-duplicates -> packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` applies them one after the other, each result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, linededup, ngramjoin, packing, quality
from tessera.llm.common import cut, drop, table
from tessera.operators.spread import spread


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go."""
    return langid.keep(docs)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the current policy rejects go."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, and documents that held nothing else."""
    return linededup.keep(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: one document of each group stays."""
    return ngramjoin.keep(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("quality_rules", judge),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("packing", pack),
]

#: Language models, hashing and subword ids are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(table(spark, sf_dir, "documents")), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            if before is not None:
                drop(before)
            before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
