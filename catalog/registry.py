"""Names, queries and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from glyphmill.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under a name, with its SQL if there is any."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that both engines give the same types."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[
        F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def joined(values: Column, by: str = " ") -> Column:
    """An array as text."""
    return F.array_join(values.cast("array<string>"), by)


# Tables of long texts, with their keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


class Tables:
    """The given tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return readers.spread_small(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


# SQL that several oracles share.

# The white-space class of the text functions, as an RE2 class.
SPACE = (
    r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_last(text: str, mark: str, limit: int) -> str:
    head = f"substring({text}, 1, {limit})"
    return (
        f"CASE WHEN instr({head}, '{mark}') = 0 THEN -1 "
        f"ELSE length({head}) - instr(reverse({head}), '{mark}') END"
    )


def sql_bytes(text: str) -> str:
    """List of UTF-8 byte values."""
    return (
        f"list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: ('0x' || h)::BIGINT)"
    )


# (doc_id, i, c): every character of every document with its 0-based place.
SQL_CHARS = """
chars AS (
  SELECT doc_id, generate_subscripts(cs, 1) - 1 AS i, unnest(cs) AS c
  FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE text <> '')
)"""
# (token, n, first_doc, first_pos, rank) of the characters in `chars`.
SQL_RANK_OF_CHARS = """
firsts AS (
  SELECT c AS token, count(*) AS n, min(doc_id) AS first_doc FROM chars GROUP BY c
),
ranked AS (
  SELECT token, n, first_doc, first_pos,
         row_number() OVER (ORDER BY n DESC, first_doc, first_pos) - 1 AS rank
  FROM (SELECT f.token, f.n, f.first_doc, min(x.i) AS first_pos
        FROM firsts f JOIN chars x ON x.c = f.token AND x.doc_id = f.first_doc
        GROUP BY f.token, f.n, f.first_doc)
)"""
SQL_RANKED = f"{SQL_CHARS}, {SQL_RANK_OF_CHARS}"
# (doc_id, text) of the validation set, and its symbol counts.
SQL_VALIDATION = f"""
valid AS (
  SELECT doc_id, substring(text, 1, pos + 1) AS text
  FROM (SELECT doc_id, text, {sql_last('text', '.', 256)} AS pos FROM documents)
  WHERE pos >= 100 AND pos < 256
  ORDER BY doc_id LIMIT 5000
)"""


def sql_symbols(source: str, name: str = "symbols") -> str:
    """(token, n) of a (text) relation with one end mark per row."""
    return f"""
{name} AS (
  SELECT token, count(*) AS n
  FROM (SELECT unnest(string_split(text, '')) AS token FROM {source} WHERE text <> ''
        UNION ALL SELECT '</s>' FROM {source})
  GROUP BY token
)"""
