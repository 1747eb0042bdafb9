"""Splits, masking and labelled tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import arrays as A

# The labelled tasks, their kind, fields and number of classes.
TASK_KINDS = {
    "single": ["sentence"],
    "cluewsc": ["text"],
    "csl": ["abst"],
    "pair": ["sentence1", "sentence2"],
}
TASKS = {
    "tnews": ("single", 15),
    "iflytek": ("single", 119),
    "cluewsc2020": ("cluewsc", 2),
    "afqmc": ("pair", 2),
    "csl": ("csl", 2),
    "ocnli": ("pair", 3),
}
TASK_POSITIONS = 512
# Fixed values of masked modelling: shares of targets masked, replaced and kept.
MASK_SHARE, REPLACE_SHARE = 0.8, 0.1
# Numbers that make a draw from a position.
DRAW_FACTOR = 48271
# Ids that a Python task masks at a time.
_IDS_AT_ONCE = 1_000_000
DRAW_PRIMES = (2147483647, 2147483629, 2147483587)


def task_table(spark: SparkSession) -> DataFrame:
    """(task, kind, fields, classes)."""
    rows = [(t, kind, TASK_KINDS[kind], n) for t, (kind, n) in TASKS.items()]
    return spark.createDataFrame(rows, "task string, kind string, fields array<string>, classes int")


def task_fields(task: str) -> list[str]:
    if task not in TASKS:
        raise ValueError(f"unknown task: {task!r}")
    return TASK_KINDS[TASKS[task][0]]


def row_seeds(key: Column, seed: int = 0) -> Column:
    """Three 31-bit seeds of a row."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(3)]
    return F.array(*[w % 2**31 for w in words])


def position_draws(items: Column, key: Column, seed: int = 0) -> Column:
    """One number below `DRAW_PRIMES[2]` per element, from the row's key and the position.

    One hash per row, then a multiplication and two squarings modulo three primes
    per position: whole-number arithmetic that every engine does alike. Every
    product stays below 2**62.
    """
    first, second, third = DRAW_PRIMES

    def draw(seeds: Column) -> Column:
        a, b, c = (F.get(seeds, F.lit(i)) for i in range(3))
        spread = F.transform(items, lambda _, i: (i.cast("bigint") + a) * DRAW_FACTOR % first)
        mixed = F.transform(spread, lambda x: (x * x + b) % second)
        return F.transform(mixed, lambda x: (x * x + c) % third)

    return A.let(row_seeds(key, seed), draw)


def shuffle_key(key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def split_exact(rows: DataFrame, ratio: float = 0.9, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Add `split`: exactly int(n * ratio) rows are `train`, the others `val`.

    The rows are not sorted. A count per hash prefix finds the prefix that holds
    the cut; only that prefix's keys are ranked to find the last key of the
    training part, and the split is then a comparison inside each row.
    """
    digest = shuffle_key(F.col(key), seed)
    keys = rows.select(digest.alias("h"), F.col(key).alias("k"))
    prefix = F.substring("h", 1, 4)
    sizes = keys.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"))
    ends = sizes.select("p", "n", F.sum("n").over(Window.orderBy("p")).alias("end")).orderBy("p")
    table = [(r.p, r.n, r.end) for r in ends.collect()]
    cut = int((table[-1][2] if table else 0) * ratio)
    if cut == 0:
        return rows.withColumn("split", F.lit("val"))
    held, n, end = next(t for t in table if t[2] >= cut)
    last = (
        keys.where(prefix == held).orderBy("h", "k").limit(cut - (end - n))
        .agg(F.max(F.struct("h", "k")).alias("m")).first().m
    )
    in_train = (digest < last.h) | ((digest == last.h) & (F.col(key) <= F.lit(last.k)))
    return rows.withColumn("split", F.when(in_train, F.lit("train")).otherwise(F.lit("val")))


def mask_tokens(rows: DataFrame, ids: str, key: str, vocab_size: int, mask_id: int,
                specials: Sequence[int], p: float = 0.15, seed: int = 0) -> DataFrame:
    """Choose targets for masked modelling and change them.

    Adds `masked_ids` and `labels` (-100 where nothing is to be predicted). Of the
    targets 80% become the mask, 10% a drawn token, 10% stay. Special ids are never
    chosen. One draw per position decides all of it, and comes from (key, position),
    so a re-run task draws the same.
    """
    limits, kind = draw_limits(p), rows.schema[ids].dataType.simpleString()
    special = np.array(specials, np.int64)

    @F.arrow_udf(f"struct<masked_ids:{kind},labels:{kind}>")
    def change(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, seeds in batches:
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            start = 0
            while start < len(lists):
                # A few rows at a time; a row is never parted.
                most = (ends[start - 1] if start else 0) + _IDS_AT_ONCE
                size = max(int(np.searchsorted(ends, most, "right")) - start, 1)
                yield _masked(lists.slice(start, size), seeds.slice(start, size), limits, vocab_size, mask_id, special)
                start += size

    changed = rows.withColumn("_changed", change(F.col(ids), row_seeds(F.col(key), seed)))
    return changed.withColumns({n: F.col(f"_changed.{n}") for n in ("labels", "masked_ids")}).drop("_changed")


def _masked(lists: pa.Array, seeds: pa.Array, limits: tuple[int, int, int], vocab_size: int, mask_id: int,
            special: np.ndarray) -> pa.Array:
    """(masked_ids, labels) of lists of ids, with the draws of `position_draws`."""
    chosen, masked, replaced = limits
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = lists.flatten()
    none = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).to_numpy().astype(np.int64)
    a, b, c = (np.repeat(column, sizes) for column in seeds.flatten().to_numpy().reshape(-1, 3).T)
    first, second, third = DRAW_PRIMES
    spread = (np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + a) * DRAW_FACTOR % first
    mixed = (spread * spread + b) % second
    r = (mixed * mixed + c) % third
    free = none | ~np.isin(x, special)
    token = np.floor((r - masked) * vocab_size / (replaced - masked)).astype(np.int64)
    kept = (r >= replaced) | ~free
    out = np.where(kept, x, np.where(r < masked, mask_id, token))
    labels = np.where((r < chosen) & free & ~none, x, -100)
    offsets, gone = pa.array(ends, pa.int32()), lists.is_null() if lists.null_count else None
    kind = lists.type.value_type
    parts = [pa.array(out, kind, mask=kept & none), pa.array(labels, kind)]
    columns = [pa.ListArray.from_arrays(offsets, part, mask=gone) for part in parts]
    return pa.StructArray.from_arrays(columns, names=["masked_ids", "labels"])


def draw_limits(p: float) -> tuple[int, int, int]:
    """Draws below the first choose a target, below the second mask it, and from
    there to the third replace it."""
    chosen = int(DRAW_PRIMES[2] * p)
    return chosen, int(chosen * MASK_SHARE), int(chosen * (MASK_SHARE + REPLACE_SHARE))


def cut_pair(first: Column, second: Column, room: int) -> tuple[Column, Column]:
    """Shorten two sequences to `room` together, taking from the longer one first.

    One id at a time from the longer (from the second when they are equal) ends at
    these sizes.
    """
    a, b = F.size(first), F.size(second)
    over = F.greatest(a + b - room, F.lit(0))
    gap = F.least(F.abs(a - b), over)
    rest = over - gap
    cut_a = F.when(a > b, gap).otherwise(F.lit(0)) + F.floor(rest / 2)
    cut_b = F.when(b > a, gap).otherwise(F.lit(0)) + F.ceil(rest / 2)
    return (
        F.slice(first, F.lit(1), (a - cut_a).cast("int")),
        F.slice(second, F.lit(1), (b - cut_b).cast("int")),
    )


def join_pair(first: Column, second: Column | None, start: int, end: int) -> Column:
    """start a end, or start a end end b end."""
    one = A.wrap_specials(first, start, end)
    return one if second is None else F.concat(one, A.wrap_specials(second, end, end))
