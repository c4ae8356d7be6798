"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from ..operators.spread import spread
from . import chat, embdedup, langid, licenses, linededup, ngramjoin, packing, quality, sentpiece, sharding
from .common import table


def queries() -> dict:
    docs = lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))
    python = lambda f, name="documents": lambda spark, sf_dir: f(spread(table(spark, sf_dir, name)))
    return {
        "op1_quality_rules": docs(quality.query),
        "quality_ablation": docs(quality.ablation_query),
        "op2_line_dedup": python(linededup.query),
        "op3_sharding": docs(sharding.query),
        "op4_packing": python(packing.query),
        "op5_chat_formatting": lambda spark, sf_dir: chat.query(table(spark, sf_dir, "conversations")),
        "op6_ngram_join": python(ngramjoin.query),
        "op7_language_id": python(langid.query),
        "op8_sentencepiece": python(sentpiece.query),
        "op9_license_scan": python(licenses.query),
        "op10_embedding_dedup": python(embdedup.query, "embeddings"),
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": quality.SQL, "quality_ablation": quality.ABLATION_SQL, "op5_chat_formatting": chat.SQL, "op6_ngram_join": ngramjoin.SQL}
