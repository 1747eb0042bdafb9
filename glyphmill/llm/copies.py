"""Exact copies: rows grouped by a 128-bit hash of their text, the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C


def normalised(text: Column) -> Column:
    """The text with one space for each run of ASCII white space; null counts as empty. Single
    spaces are left as they stand, so the pattern only matches what has to change."""
    changing = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), changing, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def text_groups(rows: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(hash, digest, keep, first, n) of (_key, _row, text): one row per distinct text, with its
    smallest key and the row that has it.

    Rows meet by hash and bytes together, so texts that share a hash are told apart by comparing
    them, and a text that a third of all rows share is summed before it moves.
    """
    sums = rows.withColumn("hash", hashed(F.col("text"))).groupBy("hash", "text").agg(
        F.min("_key").alias("keep"),
        F.coalesce(F.min_by("_row", "_key"), F.min("_row")).alias("first"),
        F.count("*").alias("n"),
    )
    return sums.select("hash", _digest(F.col("text")).alias("digest"), "keep", "first", "n")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
           hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(key, keep, n, kept, digest) of every row.

    Rows are copies when their texts are the same bytes after each run of ASCII white space became
    one space; a null text counts as empty. The row with the smallest key stays: `keep` is its key,
    `n` the number of rows in the group, `digest` the SHA-256 of the text, as bytes. Null keys come
    after all others, and stay only in groups without any other; of rows that share the smallest key
    one stays. Repeated rows are copies of each other. An empty table gives no rows; other columns
    are not read, whatever their names.
    """
    named = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    rows = C.identified(named, "_key", "_row", "_text").select("_key", "_row", normalised(F.col("_text")).alias("text"))
    found = C.staged(text_groups(rows, hashed), "texts")
    marked = C.staged(
        rows.select("_key", "_row", hashed(F.col("text")).alias("hash"), _digest(F.col("text")).alias("digest")), "marks",
    )
    joined = C.spread_join(marked, found, ["hash", "digest"], "n")
    return joined.select(
        F.col("_key").alias(key), "keep", "n", (F.col("_row") == F.col("first")).alias("kept"), "digest"
    )


def first_of_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; needs keys that are unique."""
    stays = groups(docs, key, text).where("kept").select(F.col(key).alias("_keep"))
    return docs.join(stays, F.col(f"`{key}`").eqNullSafe(F.col("_keep")), "left_semi")


# The same in SQL.
ORACLE = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{C.SPACE}', ' ', 'g') AS text FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id,
             count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256 FROM t)
"""
