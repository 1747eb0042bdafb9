"""The validation set: trimmed texts, and their unigram bits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import corpus, metrics


def validation_set(docs: DataFrame, n: int = 5000, mark: str = "。", low: int = 100,
                   high: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first `n` documents that have a text and a mark in range, cut behind it."""

    def passing(rows: DataFrame) -> DataFrame:
        return corpus.trim_to_mark(corpus.non_empty(rows, text), mark, low, high, text)

    return corpus.first_passing(docs.select(key, text), n, passing, key)


def validation_bits(docs: DataFrame, text: str = "text") -> DataFrame:
    """(symbols, bits) of a set under its own unigram model."""
    return metrics.unigram_bits(metrics.unigram_model(docs, text))
