"""Positions and running values in a total order, without one-task windows.

A window without a partition, or one over a group that holds a third of the
rows, runs in a single task. Here every group is cut into ordered buckets: the
bucket totals (at most a few thousand rows per group) are accumulated first, and
each bucket then only needs a window over its own rows.

Bucket bounds are plain numbers fixed before the query is built, so both reads of
the input, and any re-run of a lost task, put a row into the same bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

# Buckets are a power of two: at least 256, and some per core up to 4096.
_LEAST_DEPTH, _MOST_DEPTH = 8, 12


def sampled_keys(df: DataFrame, key: str, count: int = 1024, salt: int = 0) -> list:
    """Up to `count` distinct keys of any ordered type, in order: of the keys whose hash falls into one of
    `count` cells, the one with the greatest hash. The same keys give the same sample, wherever they are."""
    mixed = F.xxhash64(F.lit(salt), F.col(key))
    cells = df.where(F.col(key).isNotNull()).groupBy(F.pmod(mixed, F.lit(count)).alias("cell"))
    picked = cells.agg(F.max_by(key, mixed).alias("k"))
    return [r.k for r in picked.select("k").orderBy("k").collect()]


def key_bounds(df: DataFrame, key: str) -> list:
    """Keys that cut the rows into 256 to 4096 buckets: approximate quantiles of a number, a sample of
    the distinct keys of any other type. One pass over that column alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    count = 2 ** min(max((2 * cores - 1).bit_length(), _LEAST_DEPTH), _MOST_DEPTH)
    if isinstance(df.schema[key].dataType, NumericType):
        shares = [i / count for i in range(1, count)]
        row = df.agg(F.percentile_approx(key, shares, 20 * count).alias("b")).first()
        bounds = sorted(row.b or [0])
    else:
        bounds = sampled_keys(df, key, count - 1) or [None]
    return bounds + [bounds[-1]] * (count - 1 - len(bounds))


def bucket_of(key: Column, bounds: Sequence) -> Column:
    """Number of bounds below the key, by binary search; never decreases with it."""
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(key > F.get(table, low + step - 1), low + step).otherwise(low),
    )


_FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, values: Mapping[str, tuple[str, Column, bool]], order: Sequence[Column],
            bucket: Column, within: Sequence[str] = ()) -> DataFrame:
    """Add running sums, minima or maxima in `order`.

    `values` maps a new column to (sum | min | max, expression, whether the row itself
    counts). `bucket` never decreases along the order; `within` names the groups.
    What comes before the first row is null.

    The totals of the earlier buckets enter each bucket as one more row, ahead of
    the others. So the rows are shuffled once, by group and bucket, and not joined.
    """
    inputs = {name: f"_in_{name}" for name in values}
    rows = df.withColumn("_bucket", bucket).withColumn("_kind", F.lit(1))
    for name, (_, value, _) in values.items():
        rows = rows.withColumn(inputs[name], value)
    keys = [*within, "_bucket"]
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(
        *[_FUNCTIONS[how](inputs[name]).alias(inputs[name]) for name, (how, _, _) in values.items()]
    )
    carry = totals.select(
        *keys, F.lit(0).alias("_kind"),
        *[_FUNCTIONS[how](inputs[name]).over(before).alias(inputs[name])
          for name, (how, _, _) in values.items()],
    )
    placed = rows.unionByName(carry, allowMissingColumns=True)
    own = Window.partitionBy(*keys).orderBy("_kind", *order)
    for name, (how, _, inclusive) in values.items():
        frame = own.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        placed = placed.withColumn(name, _FUNCTIONS[how](inputs[name]).over(frame))
    return placed.where(F.col("_kind") == 1).drop("_bucket", "_kind", *inputs.values())


def ordered_index(df: DataFrame, out: str, order: Sequence[Column], bucket: Column,
                  within: Sequence[str] = ()) -> DataFrame:
    """Add `out`: the 0-based position of each row in a total order."""
    ones = F.lit(1).cast("bigint")
    placed = running(df, {out: ("sum", ones, False)}, order, bucket, within)
    return placed.withColumn(out, F.coalesce(out, F.lit(0)))
