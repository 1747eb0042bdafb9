"""Entropy, bits per byte, accuracy and the ratios made from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A, lookup as L, text as T
from ..session import materialize
from .ordering import bucket_of, key_bounds, ordered_index

# Fixed value: the symbol that ends every document in the unigram model.
END_MARK = "</s>"


def symbol_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): characters, and one end mark per document, in one pass."""
    with_end = F.concat(T.char_tokens(F.col(text)), F.array(F.lit(END_MARK)))
    return docs.select(F.explode(with_end).alias("token")).groupBy("token").agg(
        F.count("*").alias("n")
    )


def scale_by_total(counts: DataFrame, value: str = "n", out: str = "p") -> DataFrame:
    """Add each row's share of the total, a one-row scalar."""
    return counts.withColumn(out, F.col(value) / counts.agg(F.sum(value)).scalar())


def unigram_model(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, p) with the end mark: the learned model.

    It is written to the shared folder, so that every use of it costs a read of at
    most one row per code point and not a pass over the texts.
    """
    return scale_by_total(materialize(symbol_counts(docs, text), "unigrams"))


def unigram_bits(model: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(symbols, bits) of counted symbols under a model; by default its own counts.

    Works on counts: one logarithm per distinct symbol.
    """
    rows = model if counts is None else counts.join(model.select("token", "p"), "token")
    return rows.agg(
        F.sum("n").alias("symbols"), F.sum(-F.col("n") * F.log2("p")).alias("bits")
    )


def score_under_model(counts: DataFrame, model: DataFrame, strict: bool = False) -> DataFrame:
    """(symbols, bits, unseen): a second corpus under a learned model. Symbols the
    model lacks are counted apart, or raise when `strict`."""
    rows = counts.join(model.select("token", "p"), "token", "left")
    if strict:
        problem = F.concat(F.lit("symbol not in model: "), F.col("token"))
        rows = rows.withColumn("p", F.coalesce("p", F.raise_error(problem).cast("double")))
    seen = F.col("p").isNotNull()
    return rows.agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("symbols"),
        F.coalesce(F.sum(-F.col("n") * F.log2("p")), F.lit(0.0)).alias("bits"),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("unseen"),
    )


def token_total(encoded: DataFrame, mask: str = "attention_mask", by: str | None = None) -> DataFrame:
    """Sum of the attention masks, per tokenizer when `by` is given."""
    ones = F.sum(A.total(F.col(mask))).alias("tokens")
    return encoded.groupBy(by).agg(ones) if by else encoded.agg(ones)


def nats_to_bits(loss: Column) -> Column:
    return loss / math.log(2)


def une(loss: Column, tokens: Column, bits: Column) -> Column:
    """Unigram-normalized entropy from a mean loss in nats."""
    return nats_to_bits(loss) * tokens / bits


def per_token_ratio(une_value: Column, symbols: Column, tokens: Column) -> Column:
    return une_value * symbols / tokens


def sequence_stats(rows: DataFrame, by: list[str], nll: str = "nll", n_bytes: str = "n_bytes",
                   weight: str | None = None, pad: str | None = None) -> DataFrame:
    """Per sequence: nats, tokens and bytes. `weight` counts equal rows; `pad` names a
    flag of padding rows to leave out, which otherwise count like tokens."""
    if pad is not None:
        rows = rows.where(~F.col(pad))
    w = F.col(weight) if weight else F.lit(1)
    return rows.groupBy(*by).agg(
        F.sum(F.col(nll) * w).alias("nats"), F.sum(w).alias("tokens"),
        F.sum(F.col(n_bytes) * w).alias("n_bytes"),
    )


def bits_per_byte(stats: DataFrame, batch: str = "batch") -> DataFrame:
    """(bits_per_byte, micro_bits_per_byte) from sequence statistics.

    The first is the unweighted mean over batches of (mean over sequences of bits
    per token) x (tokens / bytes of the batch); the second is all bits / all bytes.
    """
    per_batch = stats.groupBy(batch).agg(
        F.avg(nats_to_bits(F.col("nats")) / F.col("tokens")).alias("bits_per_token"),
        F.sum("tokens").alias("tokens"), F.sum("n_bytes").alias("n_bytes"),
        F.sum("nats").alias("nats"),
    )
    return per_batch.agg(
        F.avg(F.col("bits_per_token") * F.col("tokens") / F.col("n_bytes")).alias("bits_per_byte"),
        (nats_to_bits(F.sum("nats")) / F.sum("n_bytes")).alias("micro_bits_per_byte"),
    )


def text_nll(text: Column, model: DataFrame, missing: float = 0.0) -> Column:
    """Nats of a text's characters under a unigram model, inside the row."""
    costs = model.select("token", (-F.log("p")).alias("nats"))
    table = L.char_table(costs, "token", "nats", missing, "double", L.CODE_POINTS)
    return F.aggregate(
        T.char_tokens(text), F.lit(0.0), lambda acc, c: acc + L.at(table, F.ascii(c), missing)
    )


def accuracy(rows: DataFrame, prediction: str, label: str, by: str | None = None) -> DataFrame:
    """(correct, total, accuracy), per task when `by` is given."""
    hit = (F.col(prediction) == F.col(label)).cast("bigint")
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(
        F.sum(hit).alias("correct"), F.count("*").alias("total"), F.avg(hit).alias("accuracy")
    )


def batch_id(rows: DataFrame, size: int, key: str = "doc_id", out: str = "batch") -> DataFrame:
    """Number fixed-size batches in key order, without a one-task window."""
    bucket = bucket_of(F.col(key), key_bounds(rows, key))
    numbered = ordered_index(rows, "_place", [F.col(key)], bucket)
    whole = F.col("_place") - F.col("_place") % size
    return numbered.withColumn(out, (whole / size).cast("bigint")).drop("_place")
