"""Passages that occur more than once, found by anchors at the places of a difference cover."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

# A passage of so many words is removed where it occurs again.
WINDOW = 35
# Anchors stand at some of every PERIOD places and are WINDOW - PERIOD + 1 words long.
PERIOD = 21


@lru_cache(maxsize=8)
def difference_cover(period: int) -> tuple[int, ...]:
    """A least set of residues whose differences are all residues: for any two places there is a
    shift below `period` after which both stand at residues of the set."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


def _unlike(hashes: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, known): `known` are the places whose hash comes twice in the chunk. One of each keeps
    its hash, to tell other chunks; the others get a key that nothing else has."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.zeros(len(hashes), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    known = same.copy()
    known[:-1] |= same[1:]
    keys = hashes.copy()
    later = order[same]
    keys[later] = C.mix(hashes[later] ^ C.mix(spread[later]))
    flags = np.zeros(len(hashes), bool)
    flags[order] = known
    return keys, flags


def _batch(keys: np.ndarray, rows: np.ndarray, places: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [C.signed(keys), pa.array(rows), pa.array(places, pa.int32()), pa.array(known)],
        names=["h", "_row", "place", "known"],
    )


_FOUND = "h bigint, _row bigint, place int, known boolean"


def _spread(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    return C.mix(rows.astype(np.uint64)) ^ places.astype(np.uint64)


def _anchors(window: int, period: int, bits: int):
    length, cover = window - period + 1, np.zeros(period, bool)
    cover[list(difference_cover(period))] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text"):
            words = C.Words(batch.column("text"))
            # An anchor is of use only in a text with room for a window.
            fits = (words.places + length <= words.sizes[words.rows]) & (words.sizes[words.rows] >= window)
            at = np.flatnonzero(fits & cover[words.places % period])
            hashes = C.Windows(words.hashes()).at(at, length) >> np.uint64(64 - bits)
            rows = batch.column("_row").to_numpy()[words.rows[at]]
            places = words.places[at]
            keys, known = _unlike(hashes, _spread(rows, places))
            yield _batch(keys, rows, places, known)

    return work


def _windows(window: int, period: int):
    reach = period

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text"):
            words = C.Words(batch.column("text"))
            marks = batch.column("places")
            at = words.first[np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy())]
            at = at + marks.flatten().to_numpy()
            # Windows that begin at most period - 1 words before a repeated anchor.
            open_ = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(open_, np.maximum(at - reach + 1, 0), 1)
            np.add.at(open_, at + 1, -1)
            near = np.cumsum(open_)[:-1] > 0
            starts = np.flatnonzero(near & (words.places + window <= words.sizes[words.rows]))
            rows = batch.column("_row").to_numpy()[words.rows[starts]]
            places = words.places[starts]
            hashes = C.Windows(words.hashes()).at(starts, window)
            keys, known = _unlike(hashes, _spread(rows, places))
            yield _batch(keys, rows, places, known)

    return work


def _again(found: DataFrame) -> DataFrame:
    """(_row, places): the places whose hash comes more than once, by row. Rows of a hot hash met in
    chunks, where all but one have keys of their own, so no key has more rows than there are chunks."""
    several = F.count("*").over(Window.partitionBy("h")) > 1
    kept = found.select("_row", "place", "known", several.alias("several")).where("known or several")
    return kept.groupBy("_row").agg(F.collect_list("place").alias("places"))


def repeated_places(texts: DataFrame, window: int = WINDOW, period: int | None = None) -> DataFrame:
    """(_row, places) of (_row, text): where the words of a window start that starts elsewhere too.

    Any two equal windows hold, at one and the same shift below the period, an anchor each, as the
    places of anchors are a difference cover. So only windows near an anchor that occurs twice are
    hashed whole, and those whose hash occurs twice are the repeats. Anchor hashes are as long as
    the amount of text asks for: a chance match costs a needless look, nothing else.
    """
    period = min(period or PERIOD, window)
    texts = texts.select("_row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(63, max(24, int(size).bit_length() + 6))
    anchors = C.staged(_again(texts.mapInArrow(_anchors(window, period, bits), _FOUND)), "anchors")
    marked = texts.join(anchors, "_row")
    return C.staged(_again(marked.mapInArrow(_windows(window, period), _FOUND)), "windows")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    period: int | None = None) -> DataFrame:
    """(key, n_words, n_removed, kept, spans) of every row.

    Words are runs without ASCII white space, unchanged. Every word that a window covers is removed
    if the window's words also start anywhere else, in the same text or another; `kept` is the
    rest with one space between, `spans` the removed runs as (start, stop) word places. All
    copies go, also the first. Null or empty texts have no words; rows that repeat a key, or
    have none, are texts of their own, so a repeated row of `window` words is emptied.
    """
    rows = C.identified(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")), "_key", "_row", "text")
    places = repeated_places(rows.select("_row", "text"), window, period)
    kind = dict(rows.dtypes)["_key"]
    schema = f"_key {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,stop:bigint>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text"):
            out: list[list] = [[], [], [], []]
            pairs = zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("places"))
            for body, starts in pairs:
                words = (body or b"").split()
                spans = []
                kept = words
                if starts.is_valid:
                    at = np.sort(starts.values.to_numpy())
                    breaks = np.flatnonzero(np.diff(at) > window)
                    firsts = at[np.concatenate([[0], breaks + 1])].tolist()
                    lasts = (at[np.concatenate([breaks, [len(at) - 1]])] + window).tolist()
                    spans = [{"start": a, "stop": b} for a, b in zip(firsts, lasts)]
                    kept, place = [], 0
                    for a, b in zip(firsts, lasts):
                        kept += words[place:a]
                        place = b
                    kept += words[place:]
                for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode(), spans)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["_key", "n_words", "n_removed", "kept", "spans"],
            )

    joined = rows.select("_key", "_row", F.col("text").cast("string").alias("text")).join(places, "_row", "left")
    return joined.select("_key", "text", "places").mapInArrow(cut, schema).withColumnRenamed("_key", key)


# The same in SQL, from all windows.
ORACLE = rf"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{C.SPACE}'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + {WINDOW}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW} + 1)) AS s FROM dw WHERE len(w) >= {WINDOW})
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM again
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM dw
), rest AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM dw LEFT JOIN rest USING (doc_id)
"""
