"""SQL functions of a tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.charclass import MARKER
from ..operators.kernel import Tokenizer, offset
from ..operators.tokenize import ids_column, tokens_column


def register(spark: SparkSession, tokenizer: Tokenizer, prefix: str = "") -> None:
    """Registers tokenize(text), token_ids(text), decode_ids(ids) and the table function tokens(text)."""
    spark.udf.register(f"{prefix}tokenize", tokens_column(spark, tokenizer))
    spark.udf.register(f"{prefix}token_ids", ids_column(spark, tokenizer))

    shared = spark.sparkContext.broadcast(tokenizer.vocab)

    @F.pandas_udf(StringType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in ids:
            yield s.map(lambda x: None if x is None else "".join(map(shared.value.id_to_token, x)).replace(MARKER, " "))

    spark.udf.register(f"{prefix}decode_ids", decode)

    class Tokens:
        def eval(self, text: str):
            for pos, t in enumerate(tokenizer.tokenize(text)):
                at = offset(t.refs) or {"begin": None, "end": None}
                yield pos, t.text, tokenizer.vocab.token_to_id(t.text), at["begin"], at["end"], int(t.mask)

    spark.udtf.register(f"{prefix}tokens", F.udtf(Tokens, returnType="pos int, token string, id bigint, begin int, end int, mask int"))
