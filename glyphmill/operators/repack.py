"""Re-coding tokens as short byte strings by frequency rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A, lookup as L

# The first code is the space; surrogates are not valid in UTF-8.
FIRST_CODE = 32
SURROGATES_FROM, SURROGATES = 0xD800, 0x800
CODES = L.CODE_POINTS - FIRST_CODE - SURROGATES


def byte_code(rank: Column) -> Column:
    """Bytes of the rank-th valid UTF-8 sequence from the space on; null beyond the last."""
    plain = rank + FIRST_CODE
    cp = F.when(plain >= SURROGATES_FROM, plain + SURROGATES).otherwise(plain).cast("int")
    tail = lambda shift: F.lit(0x80) + F.shiftright(cp, shift).bitwiseAND(F.lit(0x3F))
    return (
        F.when((rank < 0) | (rank >= CODES), F.lit(None))
        .when(cp < 0x80, F.array(cp))
        .when(cp < 0x800, F.array(F.lit(0xC0) + F.shiftright(cp, 6), tail(0)))
        .when(cp < 0x10000, F.array(F.lit(0xE0) + F.shiftright(cp, 12), tail(6), tail(0)))
        .otherwise(F.array(F.lit(0xF0) + F.shiftright(cp, 18), tail(12), tail(6), tail(0)))
    )


def assign_byte_codes(ranked: DataFrame, unk: str = "<unk>") -> DataFrame:
    """(token, rank, code): one byte string per ranked token; the unknown mark comes
    last. Ranks past the last code get none, and one code is kept for the mark."""
    tokens = ranked.select(F.col("token").cast("string").alias("token"), "rank")
    last = ranked.agg(F.least(F.count("*"), F.lit(CODES - 1)).alias("rank"))
    mark = last.select(F.lit(unk).alias("token"), F.col("rank").cast("bigint").alias("rank"))
    return (
        tokens.where((F.col("rank") < CODES - 1) & (F.col("token") != unk))
        .unionByName(mark)
        .withColumn("code", byte_code(F.col("rank")))
    )


def apply_remap(tokens: DataFrame, remap: DataFrame, unk: str | None = "<unk>",
                literal_mark: str = "<unk>") -> DataFrame:
    """Add `code` to a token table; unknown tokens get the unknown mark's code, or
    with `unk` None the bytes of the literal mark."""
    table = remap.select(F.col("token").alias("_token"), F.col("code").alias("_code"))
    if unk is None:
        fallback = F.array(*[F.lit(b) for b in literal_mark.encode()])
    else:
        fallback = remap.where(F.col("token") == unk).agg(F.first("code")).scalar()
    return (
        tokens.join(table, F.col("token") == F.col("_token"), "left")
        .withColumn("code", F.coalesce("_code", fallback))
        .drop("_token", "_code")
    )


def ranks_of(values: Column) -> Column:
    """Ranks of an array of bytes that holds codes one after another. The first byte of a code tells
    its length; codes that are not whole, and bytes before the first one, give none."""

    def rank(codes: Column, first: Column, i: Column) -> Column:
        tail = lambda k: F.get(codes, i + k).bitwiseAND(F.lit(0x3F))
        point = (
            F.when(first < 0x80, first)
            .when(first < 0xE0, F.shiftleft(first.bitwiseAND(F.lit(0x1F)), 6) + tail(1))
            .when(first < 0xF0, F.shiftleft(first.bitwiseAND(F.lit(0x0F)), 12) + F.shiftleft(tail(1), 6) + tail(2))
            .otherwise(F.shiftleft(first.bitwiseAND(F.lit(0x07)), 18) + F.shiftleft(tail(1), 12)
                       + F.shiftleft(tail(2), 6) + tail(3))
        )
        plain = F.when(point >= SURROGATES_FROM + SURROGATES, point - SURROGATES).otherwise(point) - FIRST_CODE
        return F.when(first.bitwiseAND(F.lit(0xC0)) != 0x80, plain)

    whole = A.let(values.cast("array<int>"), lambda codes: F.transform(codes, lambda b, i: rank(codes, b, i)))
    return F.filter(whole, lambda r: r.isNotNull())


def repacked_ids(ids: Column, codes: dict[int, list[int]], unknown: list[int], offset: int) -> Column:
    """Byte ids of an array of token ids: each id's code, plus the offset.

    The codes travel as one literal array indexed by token id.
    """
    table = L.dense_lists({i: [b + offset for b in code] for i, code in codes.items()})
    default = F.array(*[F.lit(b + offset) for b in unknown])
    return F.flatten(F.transform(ids, lambda i: F.coalesce(F.get(table, i), default)))
