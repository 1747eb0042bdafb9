"""Counting, ranking and numbering tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..functions import text as T
from ..session import materialize
from .corpus import max_examples, widening_prefixes
from .ordering import bucket_of, key_bounds, ordered_index

# Counts from here on share one bucket per power of two; below, equal counts
# share one and are cut further by the document where the token came first.
_FINE_COUNTS = 1024
# A whole-number key and a position make one number of up to 32 digits.
_PLACES = 2**31
# The first prefix that is tried for a cap on distinct characters.
_FIRST_PREFIX = 256


def char_column(text: str = "text") -> Column:
    """The characters of a text column, separators left out."""
    return T.char_tokens(T.drop_separators(F.col(text)))


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) per character."""
    return token_counts(docs, char_column(text))


def token_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """(token, n) over an array expression.

    The expression is exploded where it is made: exploding a named array column
    would make the optimizer test its size first, and so compute it twice.
    """
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(
        F.count("*").alias("n")
    )


def counts_with_first(docs: DataFrame, tokens: Column | None = None,
                      key: str = "doc_id") -> DataFrame:
    """(token, n, first_doc, first_pos): counts with the place of first appearance.

    One pass and one aggregation for keys of any ordered type, repeated ones too: the least
    place. A whole-number key and a position are one number, a decimal only for keys of more
    than 31 bits, which a hash aggregation can hold; other keys are compared with their positions as they are. The result is
    written to the shared folder: it is small next to the texts, and ranking reads it twice.
    """
    tokens = char_column() if tokens is None else tokens
    whole = isinstance(docs.schema[key].dataType, IntegralType)
    if whole and _fits_long(docs, key):
        head = F.col(key).cast("bigint") * F.lit(_PLACES)
        rows = docs.select(head.alias("head"), F.posexplode(tokens).alias("pos", "token"))
        least = F.min(F.col("head") + F.col("pos"))
        counts = rows.groupBy("token").agg(F.count("*").alias("n"), least.alias("place"))
        found = counts.select(
            "token", "n", F.shiftright("place", 31).cast(docs.schema[key].dataType).alias("first_doc"),
            F.col("place").bitwiseAND(F.lit(_PLACES - 1)).alias("first_pos"),
        )
    elif whole:
        head = F.col(key).cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(10,0)")
        rows = docs.select(head.alias("head"), F.posexplode(tokens).alias("pos", "token"))
        least = F.min(F.col("head") + F.col("pos").cast("decimal(10,0)"))
        counts = rows.groupBy("token").agg(F.count("*").alias("n"), least.alias("place"))
        pos = F.pmod("place", F.lit(_PLACES).cast("decimal(10,0)"))
        doc = F.call_function("div", F.col("place") - F.col("first_pos"), F.lit(_PLACES).cast("decimal(10,0)"))
        found = counts.withColumn("first_pos", pos).select(
            "token", "n", doc.cast(docs.schema[key].dataType).alias("first_doc"), F.col("first_pos").cast("bigint").alias("first_pos")
        )
    else:
        rows = docs.select(F.col(key).alias("doc"), F.posexplode(tokens).alias("pos", "token"))
        counts = rows.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("place"))
        found = counts.select(
            "token", "n", F.col("place.doc").alias("first_doc"), F.col("place.pos").cast("bigint").alias("first_pos")
        )
    return materialize(found, "counts")


def _fits_long(docs: DataFrame, key: str) -> bool:
    """Whether every key and a position make one whole number of 64 bits."""
    ends = docs.agg(F.min(key).alias("least"), F.max(key).alias("most")).first()
    return ends.least is None or (-_PLACES <= ends.least and ends.most < _PLACES)


def add_counts(parts: DataFrame) -> DataFrame:
    """One (token, n, first_doc, first_pos) table from those of several parts of a corpus."""
    first = F.min(F.struct("first_doc", "first_pos")).alias("first")
    return parts.groupBy("token").agg(F.sum("n").alias("n"), first).select(
        "token", "n", "first.first_doc", "first.first_pos"
    )


def frequency_rank(counts: DataFrame, bounds: Sequence) -> DataFrame:
    """Add `rank`: 0-based, by count descending, ties by first appearance.

    `bounds` are `key_bounds` of the corpus; they split the many tokens that share
    a small count.
    """
    fine = F.col("n") < _FINE_COUNTS
    size = F.when(fine, F.col("n")).otherwise(_FINE_COUNTS + F.floor(F.log2("n")))
    place = F.when(fine, bucket_of(F.col("first_doc"), bounds)).otherwise(0)
    bucket = (-size * (len(bounds) + 1) + place).cast("bigint")
    order = [F.desc("n"), F.asc("first_doc"), F.asc("first_pos")]
    return ordered_index(counts, "rank", order, bucket)


def ranked_tokens(docs: DataFrame, tokens: Column | None = None,
                  key: str = "doc_id") -> DataFrame:
    """(token, n, first_doc, first_pos, rank) of a corpus; characters by default."""
    return frequency_rank(counts_with_first(docs, tokens, key), key_bounds(docs, key))


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent tokens."""
    return counts.orderBy(F.desc("n"), F.asc("first_doc"), F.asc("first_pos")).limit(k)


def _first_docs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, first_doc) for every character."""
    chars = F.explode(char_column(text)).alias("token")
    return docs.select(F.col(key).alias("first_doc"), chars).groupBy("token").agg(
        F.min("first_doc").alias("first_doc")
    )


def cap_documents(docs: DataFrame, max_distinct: int | None, max_docs: int | None = None,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents up to the one at which the distinct characters reach the cap.

    That document stays whole. The running sum goes over documents that bring a
    new character: at most one row per Unicode code point. Prefixes of the corpus
    are tried first, since the cap is often reached early.
    """
    docs = max_examples(docs, max_docs, key)
    if max_distinct is None:
        return docs
    for prefix in widening_prefixes(docs, _FIRST_PREFIX, key):
        new_chars = _first_docs(prefix, key, text).groupBy("first_doc").agg(
            F.count("*").alias("fresh")
        )
        so_far = F.sum("fresh").over(Window.orderBy("first_doc"))
        cut = (
            new_chars.select("first_doc", so_far.alias("seen"))
            .where(F.col("seen") >= max_distinct)
            .agg(F.min("first_doc").alias("doc"))
            .first()
            .doc
        )
        if cut is not None:
            return docs.where(F.col(key) <= F.lit(cut))
    return docs


def distinct_chars(docs: DataFrame, cap: int | None = None, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(token, first_doc, first_pos) of the characters, reading stops above `cap`."""
    if cap is not None:
        docs = cap_documents(docs, cap + 1, None, key, text)
    return counts_with_first(docs, char_column(text), key).drop("n")


def assign_ids(specials: Sequence[str], ranked: DataFrame, max_vocab: int) -> DataFrame:
    """(token, id): special tokens first, without repeats, then ranked tokens.

    At most `max_vocab` ranked rows can matter, so the numbering window is bounded.
    """
    spark = ranked.sparkSession
    heads = list(dict.fromkeys(specials))
    rest = ranked.where(F.col("rank") < max_vocab).where(~F.col("token").isin(heads))
    number = F.row_number().over(Window.orderBy("rank")) - 1 + len(heads)
    numbered = rest.select("token", number.cast("bigint").alias("id"))
    head = spark.createDataFrame(list(zip(heads, range(len(heads)))), "token string, id bigint")
    return head.unionByName(numbered).where(F.col("id") < max(max_vocab, len(heads)))


def vocab_with_added(vocab: DataFrame, added: DataFrame) -> DataFrame:
    """Vocabulary plus added tokens; the added ones win."""
    both = vocab.select("token", "id", F.lit(1).alias("from")).unionByName(
        added.select("token", "id", F.lit(0).alias("from"))
    )
    return both.groupBy("token").agg(F.min_by("id", "from").alias("id"))


def membership(tokens: DataFrame, vocab: DataFrame, unk: str = "<unk>") -> DataFrame:
    """Add `known`: the token itself, or the unknown mark."""
    known = vocab.select(F.col("token").alias("_known"))
    return (
        tokens.join(known, F.col("token") == F.col("_known"), "left")
        .withColumn("known", F.coalesce("_known", F.lit(unk)))
        .drop("_known")
    )


def tokens_to_ids(tokens: DataFrame, vocab: DataFrame, unk: str = "<unk>") -> DataFrame:
    """Add `id`: the token's id or that of the unknown mark. No broadcast is forced:
    the size of the vocabulary decides at run time."""
    unknown = vocab.where(F.col("token") == unk).agg(F.max("id")).scalar()
    return tokens.join(vocab.select("token", "id"), "token", "left").withColumn(
        "id", F.coalesce("id", unknown)
    )


def ids_to_tokens(ids: DataFrame, vocab: DataFrame, unk: str | None = "<unk>") -> DataFrame:
    """Add `token`: the id's token, or the unknown mark (null when `unk` is None)."""
    return ids.join(vocab.select("id", "token"), "id", "left").withColumn(
        "token", F.coalesce("token", F.lit(unk))
    )


def covered_chars(counts: DataFrame, coverage: float) -> DataFrame:
    """Characters, most frequent first, until their share reaches `coverage`.

    One row per code point at most, so one ordered window is bounded.
    """
    order = Window.orderBy(F.desc("n"), F.asc("token"))
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    spread = counts.withColumn("_before", before).withColumn("_total", total)
    kept = F.coalesce("_before", F.lit(0)) < F.lit(coverage) * F.col("_total")
    return spread.where(kept).drop("_before", "_total")
