"""Encoding texts as id arrays. Every step is a projection: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays as A, lookup as L, text as T

# The byte vocabulary's special ids; a byte's id is its value + 4.
BYTE_SPECIALS = {"<pad>": 0, "<s>": 1, "</s>": 2, "<unk>": 3}
BYTE_OFFSET = len(BYTE_SPECIALS)


def char_ids(text: Column, vocab: DataFrame, unk: str = "<unk>") -> Column:
    """Ids of the characters of `text`. The vocabulary's one-character tokens are
    at most one per code point and travel as a literal array."""
    rows = L.small_rows(
        vocab.where((F.length("token") == 1) | (F.col("token") == unk)).select("token", "id"),
        L.CODE_POINTS + 1,
    )
    ids = {row.token: row.id for row in rows}
    unknown = ids.get(unk, -1)
    table = L.dense_array({ord(c): i for c, i in ids.items() if len(c) == 1}, unknown, "int")
    return T.code_points(text, lambda cp: L.at(table, cp, unknown))


def byte_ids(text: Column) -> Column:
    return T.byte_tokens(text, lambda b: b + BYTE_OFFSET)


def bytes_from_ids(ids: Column) -> Column:
    """Text of byte ids; special ids carry no byte and are left out."""
    plain = F.filter(ids, lambda i: i >= BYTE_OFFSET)
    return T.bytes_to_text(F.transform(plain, lambda i: i - BYTE_OFFSET))


def joined_tokens(ids: Column, tokens: dict[int, str], unknown: str) -> Column:
    """The tokens of an array of ids in a row; ids without a token give the unknown mark."""
    table = L.dense_array(tokens, None, "string")
    return A.let(table, lambda names: F.array_join(
        F.transform(ids, lambda i: L.text_at(names, i.cast("int"), F.lit(unknown))), ""))


def byte_alphabet(spark) -> DataFrame:
    """(token, id): four specials and 256 bytes as Latin-1 characters."""
    heads = spark.createDataFrame(list(BYTE_SPECIALS.items()), "token string, id bigint")
    return heads.unionByName(
        spark.range(256).select(F.char("id").alias("token"), (F.col("id") + BYTE_OFFSET).alias("id"))
    )


def pack(docs: DataFrame, ids: str, size: int, pad: int, mask_labels: bool = False) -> DataFrame:
    """Add `input_ids`, `attention_mask`, `labels` of length `size`, and `n_cut`."""
    column = F.col(ids)
    out = docs.withColumn("input_ids", A.pad_truncate(column, size, pad)).withColumn(
        "attention_mask", A.attention_mask(column, size)
    )
    labels = A.labels_copy(
        F.col("input_ids"), F.col("attention_mask") if mask_labels else None
    )
    return out.withColumn("labels", labels).withColumn("n_cut", A.cut_count(column, size))


def longest_of_batch(sizes: DataFrame, size: str, batch: str) -> DataFrame:
    """Add `longest`, the greatest size of each row's batch; batches have a fixed small size. Made from keys and
    sizes alone, so that neither texts nor ids are grouped: texts are joined to it, and encoded there."""
    return sizes.withColumn("longest", F.max(size).over(Window.partitionBy(batch))).drop(size)


def pad_to(rows: DataFrame, ids: str, longest: Column, pad: int) -> DataFrame:
    """Add `input_ids` and `attention_mask` of `longest` positions."""
    missing = longest - F.size(ids)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))
    return rows.withColumn("attention_mask", mask).withColumn(
        "input_ids", F.concat(F.col(ids), F.array_repeat(F.lit(pad), missing))
    )


def pad_to_longest(rows: DataFrame, ids: str, batch: str, pad: int) -> DataFrame:
    """Pad rows that hold their ids to the longest of their batch; batches have a fixed small size."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return pad_to(rows.withColumn("_longest", longest), ids, F.col("_longest"), pad).drop("_longest")


def line_dataset(lines: DataFrame, vocab: DataFrame, block: int = 128, pad: int = 1,
                 wrap: tuple[int, int] | None = None, text: str = "text") -> DataFrame:
    """Strip each line, encode its characters, cut and pad to `block`."""
    ids = char_ids(T.py_strip(F.col(text)), vocab)
    if wrap is None:
        rows = lines.withColumn("ids", ids)
    else:
        start, end = wrap
        rows = lines.withColumn("ids", A.wrap_specials(F.slice(ids, 1, block - 2), start, end))
    return pack(rows, "ids", block, pad)
