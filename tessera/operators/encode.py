"""Encoding of one or two tokenized texts: truncation, overflow and templates as array expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TokenizerValueError
from ..protocols import TokenizerProtocol
from ..schema import OFFSET, Mask, Truncation
from ..sources.vocab import Vocab
from .tokenize import token_ids_column


@dataclass(frozen=True)
class Template:
    """What stands around the sequences; ids of None are left out."""

    cls_id: int | None = None
    sep_id: int | None = None

    @classmethod
    def pair(cls, vocab: Vocab) -> Template:
        return cls(vocab.token_to_id(vocab.default("cls")), vocab.token_to_id(vocab.default("sep")))

    def overhead(self, two: bool) -> int:
        return 0 if self.cls_id is None else 4 if two else 2


_TOO_SHORT = "Value error: Combined sequence length too short for requested truncation amount"
_FIRST = "Value error: First sequence too short for first only truncation"
_SECOND = "Value error: Second sequence too short for second only truncation"
_STRATEGY = "Value error: Invalid truncation strategy for single sentence truncation"
_NEEDED = "Value error: Truncation needed but no truncation requested"


def removal(n1: Column, n2: Column, two: Column, r: Column, strategy: Truncation) -> Column:
    """struct(first, second, error): how many tokens each sequence loses when r must go, in closed form."""
    d = n1 - n2
    run = F.least(r, F.abs(d))
    q = r - run
    zero = F.lit(0)
    if strategy == Truncation.LONGEST_FIRST:
        first = F.when(d > 0, run).otherwise(0) + F.ceil(q / 2).cast("int")
        second = F.when(d < 0, run).otherwise(0) + F.floor(q / 2).cast("int")
        pair_error = F.when(n1 + n2 < r, _TOO_SHORT)
    elif strategy == Truncation.ONLY_FIRST:
        first, second, pair_error = r, zero, F.when(n1 < r, _FIRST)
    elif strategy == Truncation.ONLY_SECOND:
        first, second, pair_error = zero, r, F.when(n2 < r, _SECOND)
    else:
        first, second, pair_error = zero, zero, F.lit(_NEEDED)
    alone_error = F.when(n1 < r, _FIRST)
    if strategy == Truncation.ONLY_SECOND:
        alone_error = F.when(n1 < r, _FIRST).otherwise(_STRATEGY)
    elif strategy == Truncation.DO_NOT_TRUNCATE:
        alone_error = F.when(n1 < r, _FIRST).otherwise(_NEEDED)
    error = F.when(r == 0, F.lit(None).cast("string")).when(two, pair_error).otherwise(alone_error)
    none = error.isNotNull() | (r == 0)
    return F.struct(
        F.when(none, 0).when(two, first).otherwise(r).cast("int").alias("first"),
        F.when(none | ~two, 0).otherwise(second).cast("int").alias("second"),
        error.alias("error"),
    )


def _last(x: Column, n: Column) -> Column:
    n = F.least(n, F.size(x))
    return F.slice(x, F.size(x) - n + 1, n)


def overflow(a: Column, b: Column, two: Column, r: Column, gone: Column, strategy: Truncation, stride: int) -> Column:
    """The removed ids, and before them the last stride ids that the cut sequence keeps."""
    n1, n2 = F.size(a), F.size(b)
    kept_a, kept_b = F.slice(a, 1, n1 - gone["first"]), F.slice(b, 1, n2 - gone["second"])
    lost_a, lost_b = _last(a, gone["first"]), _last(b, gone["second"])
    window = lambda x: _last(x, F.lit(stride))
    single = F.concat(window(kept_a), lost_a)
    if strategy == Truncation.LONGEST_FIRST:
        d = n1 - n2
        run = F.least(r, F.abs(d))
        q, m = r - run, F.least(n1, n2)
        turns = F.when(q > 0, F.sequence(q - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        half = lambda j: F.floor(j / 2).cast("int")
        zipped = F.transform(turns, lambda j: F.when(j % 2 == 0, F.get(a, m - 1 - half(j))).otherwise(F.get(b, m - 1 - half(j))))
        pair = F.concat(window(kept_a), zipped, F.when(d > 0, _last(a, run)).otherwise(_last(b, run)))
    elif strategy == Truncation.ONLY_SECOND:
        pair = F.concat(window(kept_b), lost_b)
    else:
        pair = single
    empty = F.array().cast("array<bigint>")
    return F.when((r == 0) | gone["error"].isNotNull(), empty).when(two, pair).otherwise(single)


def assemble(a: Column, b: Column, two: Column, template: Template) -> Column:
    """The kept sequences in their template: ids, segments, special mask, offsets, positions and masks."""
    ids = lambda *x: F.array(*[F.lit(v).cast("bigint") for v in x])
    rep = lambda v, n: F.array_repeat(F.lit(v).cast("tinyint"), n)
    one, n_one, n_two = F.lit(1), F.size(a["ids"]), F.size(b["ids"])
    blank = {"offsets": F.array(F.lit(None).cast(OFFSET)), "refs": F.array(F.array().cast("array<int>")), "masks": F.array(F.lit(int(Mask.SPECIAL)).cast("tinyint"))}
    if template.cls_id is None:
        around = lambda c, pair: F.concat(a[c], b[c]) if pair else a[c]
        seg = {False: rep(0, n_one), True: F.concat(rep(0, n_one), rep(1, n_two))}
        special = {False: rep(0, n_one), True: rep(0, n_one + n_two)}
    else:
        cls, sep = ids(template.cls_id), ids(template.sep_id)

        def around(c: str, pair: bool) -> Column:
            first, mark = (cls, sep) if c == "ids" else (blank[c], blank[c])
            return F.concat(first, a[c], mark, mark, b[c], mark) if pair else F.concat(first, a[c], mark)

        seg = {False: rep(0, n_one + 2), True: F.concat(rep(0, n_one + 2), rep(1, n_two + 2))}
        special = {False: F.concat(rep(1, one), rep(0, n_one), rep(1, one)), True: F.concat(rep(1, one), rep(0, n_one), rep(1, F.lit(2)), rep(0, n_two), rep(1, one))}
    pick = lambda c: F.when(two, around(c, True)).otherwise(around(c, False))
    return F.struct(
        pick("ids").alias("token_ids"),
        F.when(two, seg[True]).otherwise(seg[False]).alias("segment_ids"),
        F.when(two, special[True]).otherwise(special[False]).alias("special_tokens_mask"),
        pick("offsets").alias("token_offsets"),
        pick("refs").alias("reference_offsets"),
        pick("masks").alias("masks"),
    )


def encode_tokens(df: DataFrame, first: str, second: str | None, template: Template, max_len: int, strategy: Truncation | str = Truncation.LONGEST_FIRST, stride: int = 0, out: str = "encoded", on_error: str = "raise") -> DataFrame:
    """df with the encoding of tokenized columns (of ``token_ids_column``); a null second one means a single sequence.

    on_error "raise" fails the query with the reason, "null" leaves empty arrays and the reason in ``error``.
    """
    strategy = Truncation(strategy)
    columns = ("ids", "offsets", "refs", "masks")
    b = F.col(second) if second else F.lit(None).cast(df.schema[first].dataType)
    row = df.select(F.struct("*").alias("row"), F.col(first).alias("a"), b.isNotNull().alias("two"), b.alias("b"))
    none = {c: F.slice(F.col(f"a.{c}"), 1, 0) for c in columns}
    row = row.withColumn("b", F.struct(*[F.coalesce(F.col(f"b.{c}"), none[c]).alias(c) for c in columns]))
    size = F.size("a.ids") + F.size("b.ids") + F.when(F.col("two"), template.overhead(True)).otherwise(template.overhead(False))
    row = row.withColumn("r", F.greatest(F.lit(0), size - max_len))
    row = row.withColumn("gone", removal(F.size("a.ids"), F.size("b.ids"), F.col("two"), F.col("r"), strategy))
    row = row.withColumn("over", overflow(F.col("a.ids"), F.col("b.ids"), F.col("two"), F.col("r"), F.col("gone"), strategy, stride))
    keep = lambda s, g: F.struct(*[F.slice(F.col(f"{s}.{c}"), 1, F.size(f"{s}.{c}") - F.col(f"gone.{g}")).alias(c) for c in columns])
    row = row.withColumn("a", keep("a", "first")).withColumn("b", keep("b", "second"))
    row = row.withColumn("t", assemble(F.col("a"), F.col("b"), F.col("two"), template))
    failed = F.col("gone.error").isNotNull()
    part = lambda c: F.when(failed, F.slice(F.col(f"t.{c}"), 1, 0)).otherwise(F.col(f"t.{c}")).alias(c)
    error = F.col("gone.error") if on_error == "null" else F.when(failed, F.raise_error(F.col("gone.error"))).otherwise(F.lit(None).cast("string"))
    made = F.struct(
        part("token_ids"),
        part("segment_ids"),
        part("special_tokens_mask"),
        F.col("over").alias("overflowing_tokens"),
        F.when(failed, 0).otherwise(F.col("r")).alias("num_truncated_tokens"),
        part("token_offsets"),
        part("reference_offsets"),
        part("masks"),
        error.alias("error"),
    )
    return row.select("row.*", made.alias(out))


def encode(df: DataFrame, tokenizer: TokenizerProtocol, text: str = "text", text2: str | None = None, max_len: int = 128, strategy: Truncation | str = Truncation.LONGEST_FIRST, stride: int = 0, out: str = "encoded", on_error: str = "raise", template: Template | None = None) -> DataFrame:
    """df with model-ready arrays of each text, or pair of texts where the second is not null.

    Without a template it is the pair template or, for a tokenizer that is not ``paired``, none.
    """
    if max_len < 0 or stride < 0:
        raise TokenizerValueError("lengths cannot be negative")
    udf = token_ids_column(df.sparkSession, tokenizer)
    rows = df.withColumn("__a", udf(F.col(text)))
    if text2:
        rows = rows.withColumn("__b", F.when(F.col(text2).isNotNull(), udf(F.col(text2))))
    return encode_tokens(rows, "__a", "__b" if text2 else None, template or (Template.pair(tokenizer.vocab) if tokenizer.paired else Template()), max_len, strategy, stride, out, on_error).drop("__a", "__b")
