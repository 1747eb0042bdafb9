"""Choosing and trimming documents. The order of a corpus is its key column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .ordering import bucket_of, sampled_keys


def non_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(T.has_ink(F.col(text)))


def trim_to_mark(docs: DataFrame, mark: str = "。", low: int = 100, high: int = 256,
                 text: str = "text") -> DataFrame:
    """Keep rows whose last mark before `high` is at or after `low`, cut behind it."""
    at = T.last_mark_index(F.col(text), mark, high)
    return (
        docs.withColumn("_at", at)
        .where((F.col("_at") >= low) & (F.col("_at") < high))
        .withColumn(text, F.substring(F.col(text), F.lit(1), F.col("_at") + len(mark)))
        .drop("_at")
    )


# A bucket of keys that is sorted at once to find one of them.
_SORTED_AT_ONCE = 20_000


def nth_key(rows: DataFrame, n: int, key: str):
    """The n-th smallest key of any ordered type, or None when there are fewer rows. Null keys have no place.

    Keys are counted in buckets between sampled keys, then those of the one bucket that holds the place,
    until it is small or holds one key alone. Only the key column is read, and no task sorts
    more than a bucket.
    """
    keys = rows.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    size, level = keys.count(), 0
    if not 0 < n <= size:
        return None
    while size > _SORTED_AT_ONCE:
        bucket = bucket_of(F.col("k"), sampled_keys(keys, "k", salt=level))
        sizes = keys.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
        for found in sorted(sizes.collect(), key=lambda r: r.b):
            if found.n >= n:
                break
            n -= found.n
        if found.low == found.high:
            return found.low
        keys, size, level = keys.where(F.col("k").between(F.lit(found.low), F.lit(found.high))), found.n, level + 1
    return keys.orderBy("k").collect()[n - 1].k


def max_examples(docs: DataFrame, n: int | None, key: str = "doc_id") -> DataFrame:
    """The first `n` rows by key, blank ones included; all rows for None, none for 0.
    Rows that share the last key are all in.

    Only keys are sorted. The rows themselves are filtered in place, so the texts
    are not shuffled and the cut reaches the scan.
    """
    if n is not None and n <= 0:
        return docs.where(F.lit(False))
    top = None if n is None else nth_key(docs, n, key)
    return docs if top is None else docs.where(F.col(key) <= F.lit(top))


def first_n(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first `n` rows by key."""
    return docs.orderBy(key).limit(n)


def widening_prefixes(docs: DataFrame, start: int, key: str = "doc_id") -> Iterator[DataFrame]:
    """Prefixes of the corpus, each eight times longer, and at last all of it.

    For work that may be able to stop early: the sum of all tries is little more
    than the last one.
    """
    while (top := nth_key(docs, start, key)) is not None:
        yield docs.where(F.col(key) <= F.lit(top))
        start *= 8
    yield docs


def first_passing(docs: DataFrame, n: int, passing: Callable[[DataFrame], DataFrame],
                  key: str = "doc_id") -> DataFrame:
    """The first `n` rows by key that `passing` lets through.

    Tries prefixes of the corpus until enough rows pass, as a reader that stops
    would, so a large corpus is not read to its end.
    """
    held = None
    for prefix in widening_prefixes(docs, max(4 * n, 1), key):
        if held is not None and passing(held).limit(n).count() >= n:
            break
        held = prefix
    return first_n(passing(held), n, key)


def training_lines(docs: DataFrame, text: str = "text", keep_blank: bool = False) -> DataFrame:
    """Stripped texts as vocabulary training input."""
    lines = docs if keep_blank else non_empty(docs, text)
    return lines.withColumn(text, T.py_strip(F.col(text)))
