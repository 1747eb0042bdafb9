"""Tables indexed by code point or token id, held as one literal array.

A lookup by array index costs the same for 100 and for 50,000 entries, needs no
join and no shuffle, and keeps the order of the characters in their text. The
array is built from a table whose size is checked first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: number of Unicode code points, the bound of every character table.
CODE_POINTS = 0x110000
# Largest table taken into a literal; beyond it callers join instead.
MAX_ENTRIES = 200_000

_CELL = "\u001f"


class TableTooLarge(ValueError):
    """The table does not fit the literal; use the join form of the operator."""


def small_rows(df: DataFrame, limit: int = MAX_ENTRIES) -> list:
    """Rows of a table that must have at most `limit` rows; never reads more."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TableTooLarge(f"more than {limit} rows")
    return rows


def dense_array(entries: dict[int, object], missing: object, kind: str) -> Column:
    """Literal array with `entries[i]` at index i and `missing` between them.

    `kind` is the element type; a missing string is null.
    """
    if not entries:
        return F.array().cast(f"array<{kind}>")
    if kind == "string":
        return F.from_json(F.lit(json.dumps([entries.get(i) for i in range(max(entries) + 1)])), "array<string>")
    cells = [missing] * (max(entries) + 1)
    for index, value in entries.items():
        cells[index] = value
    array = F.split(F.lit(_CELL.join(str(cell) for cell in cells)), _CELL)
    return array.cast(f"array<{kind}>")


def dense_lists(entries: dict[int, list[int]]) -> Column:
    """Literal array of number lists; null where there is no entry."""
    cells = [entries.get(i) for i in range(max(entries, default=-1) + 1)]
    return F.from_json(F.lit(json.dumps(cells)), "array<array<int>>")


def at(table: Column, index: Column, missing: object) -> Column:
    """`table[index]`, or `missing` beyond the end."""
    return F.coalesce(F.get(table, index), F.lit(missing))


def text_at(table: Column, index: Column, default: Column) -> Column:
    """The string at `index`, or `default` where there is none."""
    return F.coalesce(F.get(table, index), default)


def char_table(df: DataFrame, char_col: str, value_col: str, missing: object, kind: str,
               limit: int = MAX_ENTRIES) -> Column:
    """Literal array by code point from a (character, value) table."""
    rows = small_rows(
        df.where(F.length(char_col) == 1).select(
            F.ascii(char_col).alias("cp"), F.col(value_col).alias("value")
        ),
        limit,
    )
    return dense_array({r.cp: r.value for r in rows}, missing, kind)
