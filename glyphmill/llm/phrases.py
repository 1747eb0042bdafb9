"""Phrase collocations by prefix-free parsing: n-grams are counted inside distinct chunks of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

# Phrases have up to so many words; chunks overlap by one word less.
MAX_WORDS = 3
# One in so many places between words begins a new chunk.
PERIOD = 8
# A phrase must occur so often, and a longer one so often (in per cent) to take its place.
LEAST, COVER = 10, 50
# A score of one.
ONE = 1_000_000
# Bits of the filter that the tasks get: so many for each frequent hash, up to a fixed size.
FILTER_BITS, MOST_FILTER_BITS = 32, 2**28
# A task hashes about so many bytes at a time, with some forty bytes of numbers for each.
STEP_BYTES = 1_500_000
# Parts into which a language is cut before its best phrases are ranked.
PARTS = 32

# What ends a piece, and what stands between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_DICTIONARY = "lang string, chunk string, owned int, n bigint"


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs (start, size), one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[:len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[:ends[-1]], ends


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[_flat(starts, sizes)]))]
    return pa.Array.from_buffers(pa.large_string(), len(starts), buffers)


class _Spelled:
    """Words of a column of texts as byte runs of one buffer, in which one space follows each word.
    `piece` numbers the piece that a word is in; `row` is its text."""

    def __init__(self, texts: pa.Array):
        data, ends = _bytes(texts)
        data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == 0
        # A text's first byte begins a word even if the text before ends in one.
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = ends[:-1][np.diff(ends) > 0]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        tails = ends[1:][np.diff(ends) > 0] - 1
        stops[tails] = inside[tails]
        sizes = np.flatnonzero(stops) + 1 - starts
        self.row = np.searchsorted(ends, starts, side="right") - 1
        breaks = np.cumsum(kind == 2)
        at = breaks[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(at) > 0) | (np.diff(self.row) > 0)
        self.piece = np.cumsum(new) - 1
        self.size = sizes
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.data = np.full(int((sizes + 1).sum()), 32, np.uint8)
        self.data[_flat(self.start, sizes)] = data[_flat(starts, sizes)]
        self._windows = None

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64 bits of the runs from a first to a last word."""
        if self._windows is None:
            self._windows = C.Windows(self.data.astype(np.uint64) + np.uint64(1))
        start = self.start[first]
        return self._windows.at(start, self.start[last] + self.size[last] - start)

    def texts(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        start = self.start[first]
        return _strings(self.data, start, self.start[last] + self.size[last] - start)


def _parse(overlap: int, period: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text", STEP_BYTES):
            words = _Spelled(batch.column("text"))
            n = len(words.size)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = np.diff(words.piece) > 0
            last = np.append(np.flatnonzero(new)[1:], n) - 1
            ends = last[words.piece]
            # A chunk begins with each piece and at each place whose next `overlap` words say so.
            inner = np.flatnonzero(~new & (np.arange(n) + overlap - 1 <= ends))
            said = words.hashes(inner, inner + overlap - 1) % np.uint64(period) == 0
            cut = new.copy()
            cut[inner[said]] = True
            first = np.flatnonzero(cut)
            until = np.append(first[1:], n)
            closing = until > ends[first]
            stop = np.where(closing, ends[first], until + overlap - 1)
            # Phrases that begin in the overlap belong to the chunk behind it.
            table = pa.table({
                "lang": batch.column("lang").take(pa.array(words.row[first])),
                "chunk": words.texts(first, stop),
                "owned": pa.array((until - first).astype(np.int32)),
            })
            counted = table.group_by(["lang", "chunk", "owned"], use_threads=False).aggregate([([], "count_all")])
            for part in counted.to_batches():
                yield pa.RecordBatch.from_arrays([
                    part.column("lang"), part.column("chunk").cast(pa.string()), part.column("owned"), part.column("count_all")
                ], names=["lang", "chunk", "owned", "n"])

    return work


def parse(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
          period: int = PERIOD) -> DataFrame:
    """(lang, chunk, owned, n): the dictionary of the parse, with how often each chunk stands in it.

    Texts are lower-cased (A-Z), split into pieces at marks and line breaks, and pieces into words.
    A chunk runs from one trigger (max_words - 1 words whose hash is a multiple of `period`) to the
    end of the next, or of the piece, so chunks overlap by one trigger, and every phrase of up to
    max_words words lies whole in the chunk in which it begins. `owned` is the number of words of
    the chunk at which a phrase that belongs to it may begin: the trigger at its end is not counted.
    Equal passages give equal chunks, wherever they stand, so a passage that a third of all rows
    share is summed before it moves. Null or empty texts give nothing; a null language is `und`.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")
    )
    found = texts.mapInArrow(_parse(max_words - 1, period), _DICTIONARY)
    return found.groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n"))


def _grams(words: _Spelled, owned: np.ndarray, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, last) word of every phrase that belongs to its chunk; a chunk is a row."""
    count = np.bincount(words.row, minlength=len(owned))
    head = np.cumsum(count) - count
    place = np.arange(len(words.row)) - head[words.row]
    left = count[words.row] - place
    mine = place < owned[words.row]
    for k in range(1, max_words + 1):
        first = np.flatnonzero(mine & (left >= k))
        yield first, first + k - 1


def _salt(langs: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    coded = langs.dictionary_encode()
    table = np.fromiter((xxh3_64_intdigest(x.encode()) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def _gram_hashes(max_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "chunk", STEP_BYTES):
            words, salt = _Spelled(batch.column("chunk")), _salt(batch.column("lang"))
            weight = batch.column("n").to_numpy()
            keys, counts = [], []
            for first, last in _grams(words, batch.column("owned").to_numpy(), max_words):
                row = words.row[first]
                keys.append(words.hashes(first, last) ^ salt[row])
                counts.append(weight[row])
            # One row per hash of the batch.
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            sums = np.add.reduceat(counts, heads) if len(keys) else counts
            yield pa.RecordBatch.from_arrays([C.signed(keys[heads]), pa.array(sums)], names=["h", "n"])

    return work


def _known_grams(max_words: int, bits: np.ndarray, mask: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "chunk", STEP_BYTES):
            words, salt = _Spelled(batch.column("chunk")), _salt(batch.column("lang"))
            owned = batch.column("owned").to_numpy()
            for k, (first, last) in enumerate(_grams(words, owned, max_words), 1):
                row = words.row[first]
                at = (words.hashes(first, last) ^ salt[row]) & np.uint64(mask)
                kept = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                first, last, row = first[kept], last[kept], row[kept]
                table = pa.table({
                    "lang": batch.column("lang").take(pa.array(row)), "phrase": words.texts(first, last),
                    "n": batch.column("n").take(pa.array(row)),
                })
                summed = table.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
                for part in summed.to_batches():
                    yield pa.RecordBatch.from_arrays([
                        part.column("lang"), part.column("phrase").cast(pa.string()),
                        pa.array(np.full(part.num_rows, k, np.int32)), part.column("n_sum"),
                    ], names=["lang", "phrase", "k", "n"])

    return work


def _filter(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """(words, mask): a bit for each hash, in 64-bit words. Its size has a fixed bound; where there
    are more hashes than it can tell apart, it only lets through more."""
    size = FILTER_BITS * hashes.count()
    count = min(max(1 << max(size - 1, 0).bit_length(), 64), MOST_FILTER_BITS)
    place = F.col("h").bitwiseAND(F.lit(count - 1))
    cells = hashes.groupBy(F.shiftright(place, 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("bits")
    )
    bits = np.zeros(count // 64, np.uint64)
    found = cells.toArrow()
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, count - 1


def ngram_counts(dictionary: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, k, n) of every phrase of 1 to max_words words that occurs `least` times.

    Chunks are looked at twice. First phrases are counted by hash alone, as numbers; a hash below
    `least` has no phrase that reaches it. Those that do are few: a filter of their bits goes to
    the tasks, which then send only the phrases that pass it, as texts, to be counted exactly.
    """
    hashed = dictionary.mapInArrow(_gram_hashes(max_words), "h bigint, n bigint")
    frequent = C.staged(hashed.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "hashes")
    bits, mask = _filter(frequent)
    spelled = dictionary.mapInArrow(_known_grams(max_words, bits, mask), "lang string, phrase string, k int, n bigint")
    return spelled.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _words(phrase: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of phrases of two words or more: the cut with the lowest
    score, the shortest first part among equal ones. `grams` is a written table, as `ngram_counts` gives it.

    Products are decimals of 38 digits, exact for counts up to 10^16.
    """
    cuts = grams.where("k > 1").select(
        "lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    )
    cuts = cuts.select(
        "*", _words(F.col("phrase"), F.lit(1), F.col("cut")).alias("first"),
        _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
    )
    # A frequent word is a part of many phrases: its rows are met by broadcast.
    table = grams.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    cuts = C.spread_join(C.staged(cuts, "cuts"), table, ["lang", "first"], "l")
    table = grams.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = C.spread_join(C.staged(cuts, "cuts"), table, ["lang", "rest"], "r")
    score = F.expr(f"(cast({ONE} as decimal(38,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0)))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(least)
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, cover: int = COVER, max_words: int = MAX_WORDS) -> DataFrame:
    """The phrases without those that lie inside a longer one which occurs `cover` per cent as often."""
    shorter = F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), "
        "s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    )
    inside = phrases.where("k > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True))
    return phrases.join(most, ["lang", "phrase"], "left").where(kept).drop("longer")


def best(phrases: DataFrame, count: int) -> DataFrame:
    """Add `rank`: each language's first `count` phrases by score, count and spelling. A language
    is ranked in parts first, so its last ranking has a bounded number of rows."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = Window.partitionBy("lang", "_part").orderBy(*order)
    kept = phrases.withColumn("_part", part).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return kept.drop("_part").withColumn("rank", place).where(F.col("rank") <= count)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, cover: int = COVER,
                 count: int = 2000, max_words: int = MAX_WORDS, period: int = PERIOD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_words words.

    A phrase that occurs a >= `least` times within pieces is cut where a * a / (l * r) is least, l and r
    being how often its parts occur; `n` is all words of the language. Phrases that lie in a longer
    one with `cover` per cent of their occurrences are left out, be the longer one kept or not.
    `count` phrases of a language are returned, by score, then a (both descending), then phrase.
    Null and empty texts have no words; a null language is `und`; repeated rows count again; a table
    without phrases gives no rows. Only the two columns are read.
    """
    dictionary = C.staged(parse(docs, text, lang, max_words, period), "dictionary")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("owned") * F.col("n")).alias("n"))
    grams = C.staged(ngram_counts(dictionary, least, max_words), "grams")
    kept = uncovered(C.staged(scored(grams), "scored"), cover, max_words)
    return best(kept, count).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# The same in SQL.
ORACLE = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), words AS (
  SELECT piece, lang, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM pieces
), runs AS (
  SELECT lang, word AS x, lead(word, 1) OVER same AS y, lead(word, 2) OVER same AS z
  FROM words WINDOW same AS (PARTITION BY piece ORDER BY i)
), counted AS (
  SELECT lang, x AS phrase, 1 AS k, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y AS phrase, 2 AS k, count(*) AS f FROM runs WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z AS phrase, 3 AS k, count(*) AS f FROM runs WHERE z IS NOT NULL GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, k, a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 : k], ' ') AS rest
  FROM (SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w
        FROM counted WHERE k > 1 AND f >= {LEAST})
), priced AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (({ONE}::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts LEFT JOIN counted x ON x.lang = cuts.lang AND x.phrase = head
  LEFT JOIN counted y ON y.lang = cuts.lang AND y.phrase = rest
), chosen AS (
  SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, CASE cut WHEN 1 THEN rest ELSE head END AS phrase, a AS longer FROM cuts WHERE k = 3)
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM chosen c LEFT JOIN inside i USING (lang, phrase)
  WHERE coalesce(100 * i.longer < {COVER} * c.a, true)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN totals USING (lang) WHERE rank <= 2000
"""
