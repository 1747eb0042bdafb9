"""Benchmark passages in documents, found by winnowed fingerprints and then extended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from . import common as C

# A window of so many words is what a document may not share with an item.
WINDOW = 13
# Bits of a fingerprint that hold its place; the rest are hash.
_PLACE_BITS = 30
# Item fingerprints up to this many go to every task; beyond it, the join shuffles.
BROADCAST_ROWS = 500_000

# Everything in ASCII but letters and digits separates words.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null has none."""
    return F.array_remove(F.split(F.coalesce(C.lower_ascii(text), F.lit("")), _GAPS), "")


def _beside(x: Column, step: int, join) -> Column:
    """join(x[i], x[i + step]) for every i that has both."""
    n = F.greatest(F.size(x) - step, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(step + 1), n), join)


def _spans(length: int) -> list[int]:
    """Steps that widen a window of 1 to `length`, at most doubling it each time."""
    steps, width = [], 1
    while width < length:
        step = min(width, length - width)
        steps.append(step)
        width += step
    return steps


def gram(window: int) -> int:
    """Words in a fingerprint, so that every shared window holds several choices."""
    return max(1, (window * 5 + 4) // 8)


def chosen(words: Column, window: int) -> Column:
    """Hash and place, in one number, of the smallest k-gram hash of every run of `window` words;
    of equal hashes the leftmost. Two texts that share `window` words share such a choice, at the
    same place of the shared words."""
    k = gram(window)

    def widened(x: Column, steps: list[int], join, then) -> Column:
        if not steps:
            return then(x)
        return let(_beside(x, steps[0], join), lambda y: widened(y, steps[1:], join, then))

    def placed(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.shiftleft(
            F.shiftright(h, _PLACE_BITS), _PLACE_BITS).bitwiseOR(i.cast("bigint")))

    def least(hashes: Column) -> Column:
        return let(placed(hashes), lambda x: widened(
            x, _spans(window - k + 1), lambda a, b: F.least(a, b), F.array_distinct))

    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda x: widened(x, _spans(k), lambda a, b: F.xxhash64(a, b), least),
    )


def fingerprints(rows: DataFrame, key: str, word_column: str, window: int) -> DataFrame:
    """(key, f, place) of every chosen k-gram."""
    # An outer explode: the plain one is given a filter that makes the array a second time.
    found = rows.select(key, F.explode_outer(chosen(F.col(word_column), window)).alias("_x"))
    mask = (1 << _PLACE_BITS) - 1
    return found.where("_x is not null").select(
        key, F.shiftright("_x", _PLACE_BITS).alias("f"),
        F.col("_x").bitwiseAND(F.lit(mask).cast("bigint")).alias("place"),
    )


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, item_ids, spans) per document row.

    A window is `window` consecutive words of an item, or all of a shorter item; a document
    word inside any occurrence of one is hit. `item_ids` are the items with occurring windows, as
    sorted strings (a null id is the empty string); `spans` the maximal runs of hit words as
    (start, stop) word places. Items without words match nothing. Documents without words, null
    ones too, have no hits. Rows that repeat a key, or have none, are judged each by its own text.

    Fingerprints of items and documents are joined; each hit gives an item and a shift, at which
    the document's words are compared with the item's. Only documents with a hit are compared.
    Items shorter than `window` have fingerprints of their own length, made only if there are any.
    """
    rows = C.identified(docs, key, "_row", text)
    same = f"`{key}`"
    sources = items.select(
        F.coalesce(F.col(f"`{item_key}`").cast("string"), F.lit("")).alias("item"),
        words(F.col(f"`{item_text}`")).alias("iw"),
    ).where(F.size("iw") > 0).withColumn("span", F.least(F.size("iw"), F.lit(window)))
    sources = C.staged(sources.withColumn("item_row", F.monotonically_increasing_id()), "items")
    spans = [r["span"] for r in sources.select("span").distinct().collect()]  # at most `window` numbers
    texts = rows.select("_row", words(F.col(f"`{text}`")).alias("w"))
    found = None
    for span in sorted(spans):
        of_items = fingerprints(sources.where(F.col("span") == span), "item_row", "iw", span)
        of_items = of_items.withColumnRenamed("place", "item_place")
        few = of_items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        hits = fingerprints(texts.where(F.size("w") >= span), "_row", "w", span).join(
            F.broadcast(of_items) if few else of_items, "f"
        ).select("_row", "item_row", (F.col("place") - F.col("item_place")).alias("shift"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "_row bigint, item_row bigint, shift bigint")
    found = C.staged(found.distinct(), "hits")
    compared = found.join(sources, "item_row").groupBy("_row").agg(
        F.collect_list(F.struct("item", "span", "shift", "iw")).alias("cases")
    )
    texts = rows.join(compared, "_row", "left").select(
        F.col(same), words(F.col(f"`{text}`")).alias("w"), "cases"
    )

    def starts(case: Column) -> Column:
        # Starts of whole windows, as places in the item.
        low = F.greatest(F.lit(0), -case["shift"])
        high = F.least(F.size(case["iw"]), F.size("w") - case["shift"]) - case["span"]
        places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.filter(places, lambda q: F.slice(
            case["iw"], (q + 1).cast("int"), case["span"].cast("int")
        ) == F.slice("w", (q + case["shift"] + 1).cast("int"), case["span"].cast("int")))

    matched = F.filter(
        F.transform("cases", lambda c: F.struct(
            c["item"].alias("item"), c["span"].alias("span"), c["shift"].alias("shift"), starts(c).alias("at"),
        )), lambda c: F.size(c["at"]) > 0,
    )
    texts = texts.withColumn("hit", F.coalesce(
        matched, F.array().cast("array<struct<item:string,span:int,shift:bigint,at:array<bigint>>>")
    )).withColumn("hit_words", F.array_sort(F.array_distinct(F.flatten(F.flatten(F.transform(
        "hit", lambda c: F.transform(c["at"], lambda q: F.sequence(q + c["shift"], q + c["shift"] + c["span"] - 1))
    ))))))
    runs = F.filter(
        F.zip_with("hit_words", F.concat(F.array(F.lit(-2).cast("bigint")), F.slice("hit_words", F.lit(1), F.greatest(
            F.size("hit_words") - 1, F.lit(0)))), lambda now, before: F.when(now != before + 1, now)),
        lambda place: place.isNotNull(),
    )
    ends = F.filter(
        F.zip_with("hit_words", F.concat(F.slice("hit_words", F.lit(2), F.greatest(F.size("hit_words") - 1, F.lit(0))),
                   F.array(F.lit(-2).cast("bigint"))), lambda now, after: F.when(after != now + 1, now + 1)),
        lambda place: place.isNotNull(),
    )
    return texts.select(
        F.col(same), F.size("w").cast("bigint").alias("n_words"), F.size("hit_words").cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hit", lambda c: c["item"]))).alias("item_ids"),
        F.arrays_zip(runs.alias("start"), ends.alias("stop")).alias("spans"),
    )


def contaminated() -> Column:
    """Of `contamination`'s rows: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns as they are."""
    row = C.free_name(docs, "_row")
    rows = C.identified(docs, key, row, *[c for c in docs.columns if c != key])
    bad = contamination(rows, items, row, text).where(contaminated()).select(row)
    return rows.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


# The same rows in SQL, from all windows: one is a text of words with spaces between.
ORACLE = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
         '{C.UPPER}', '{C.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iwin AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS span,
         array_to_string(w[s + 1 : s + least(len(w), {WINDOW})], ' ') AS win
  FROM (SELECT item, w, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM iw WHERE len(w) > 0)
), dwin AS (
  SELECT doc_id, s, span, array_to_string(w[s + 1 : s + span], ' ') AS win
  FROM (SELECT doc_id, w, span, unnest(range(0, len(w) - span + 1)) AS s
        FROM dw, (SELECT DISTINCT span FROM iwin) WHERE len(w) >= span)
), hits AS (
  SELECT d.doc_id, d.s, d.span, i.item FROM dwin d JOIN iwin i ON i.win = d.win AND i.span = d.span
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM (SELECT DISTINCT doc_id, s, span FROM hits))
  GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
