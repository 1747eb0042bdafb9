"""Several tokenizers on one validation set."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import metrics
from . import validation
from .tokenizers import Tokenizer


def encode_all(docs: DataFrame, forms: dict[str, Column], size: int, key: str = "doc_id") -> DataFrame:
    """(key, tokenizer, tokens): token counts of each document under each tokenizer,
    after the cut to `size` positions. One scan serves all of them."""
    counted = F.array(*[
        F.struct(F.lit(name).alias("tokenizer"),
                 F.least(F.size(ids), F.lit(size)).cast("bigint").alias("tokens"))
        for name, ids in forms.items()
    ])
    return docs.select(key, F.explode(counted).alias("c")).select(key, "c.tokenizer", "c.tokens")


def compare_tokenizers(counts: DataFrame, loss: DataFrame, bits: DataFrame) -> DataFrame:
    """(tokenizer, tokens, une, per_token) from (tokenizer, tokens) rows, a
    (tokenizer, loss) table of mean nats per token, and a one-row (symbols, bits)."""
    totals = counts.groupBy("tokenizer").agg(F.sum("tokens").alias("tokens"))
    all_bits, symbols = bits.select("bits").scalar(), bits.select("symbols").scalar()
    rows = totals.join(loss, "tokenizer").withColumn(
        "une", metrics.une(F.col("loss"), F.col("tokens"), all_bits)
    )
    return rows.select(
        "tokenizer", "tokens", "une",
        metrics.per_token_ratio(F.col("une"), symbols, F.col("tokens")).alias("per_token"),
    )


def experiment(docs: DataFrame, models: Mapping[str, Tokenizer], loss: DataFrame, size: int,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """(tokenizer, tokens, une, per_token) of a validation set under several fitted or opened tokenizers.

    Every text is read once and encoded under all of them where it is; each task adds up its
    tokens, so a row per tokenizer and task is all that moves. Null texts have no tokens.
    """
    whole = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    forms = {name: model.ids(F.col(text)) for name, model in models.items()}
    counts = encode_all(whole, forms, size, key)
    return compare_tokenizers(counts, loss, validation.validation_bits(docs, text))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
