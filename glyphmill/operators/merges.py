"""Merged vocabularies: which neighbouring symbols join, and how texts are encoded by them.

A piece (a word, usually) is a string of symbol ids, `<12><57><9>`. Joining a pair
is then a literal `replace` of `<12><57>` by `<300>`: left to right, without
overlap, and inside the JVM. A character's id is its code point; joined symbols
are numbered from the end of Unicode on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import lookup as L, text as T

FIRST_JOINED = L.CODE_POINTS
# The most tokens or merges of a vocabulary that the driver takes.
MOST_TOKENS = 1_000_000
UNKNOWN = 0

# The mark put before each word, and the pattern of the byte-level rule.
WORD_MARK = "▁"
BYTE_LEVEL_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Text that a Python task encodes at a time.
_SLICE_BYTES = 4_000_000
# Longer pieces are merged singly, the others together.
_LONG_PIECE = 256
_NO_RANK = np.iinfo(np.int64).max
# Up to this length, looking at every pair again is faster than keeping a queue.
_SHORT_PIECE = 48


def byte_level_table() -> list[int]:
    """Code point that stands for each byte: printable Latin-1 bytes keep theirs,
    the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    kept = set(plain)
    return [b if b in kept else next(spare) for b in range(256)]


def words(text: Column) -> Column:
    """Runs of characters between spaces and line breaks, as a vocabulary is learned from."""
    return F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")


def spaced_words(text: Column) -> Column:
    """Runs of characters between spaces, as a text is encoded: a line break is within a
    run, no merge knows it, and no word mark follows it."""
    return F.array_remove(F.split(text, " "), "")


def byte_level_pieces(text: Column) -> Column:
    """Pieces of the byte-level rule, each byte written as one printable character."""
    table = F.array(*[F.lit(chr(c)) for c in byte_level_table()])
    found = F.regexp_extract_all(text, F.lit(BYTE_LEVEL_PATTERN), F.lit(0))
    return F.transform(
        found, lambda p: F.array_join(F.transform(T.byte_tokens(p), lambda b: F.get(table, b)), "")
    )


def piece_counts(docs: DataFrame, pieces: Column, mark: str = "") -> DataFrame:
    """(piece, n) of distinct pieces, with `mark` put before each."""
    counts = docs.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(
        F.count("*").alias("n")
    )
    return counts.select(F.concat(F.lit(mark), "piece").alias("piece"), "n") if mark else counts


def spread(pieces: DataFrame) -> DataFrame:
    """One part per core. Distinct pieces are few bytes but much work, and parts cut
    by size alone would leave most cores idle."""
    return pieces.repartition(pieces.sparkSession.sparkContext.defaultParallelism)


def symbol_state(pieces: DataFrame, known: Column | None = None) -> DataFrame:
    """(state, n): pieces as symbol strings; `known` marks covered characters."""
    points = T.code_points(
        F.col("piece"), lambda cp: cp if known is None else L.at(known, cp, UNKNOWN)
    )
    state = F.concat(F.lit("<"), F.array_join(points.cast("array<string>"), "><"), F.lit(">"))
    return pieces.where(F.length("piece") > 1).select(state.alias("state"), "n")


def symbols(state: Column) -> Column:
    """Ids of a symbol string. The state is named once: it may be a long expression."""
    return F.split(F.btrim(state, F.lit("<>")), "><").cast("array<int>")


def pair_counts(states: DataFrame) -> DataFrame:
    """(left, right, n): neighbouring symbols, weighted by the piece counts."""
    pairs = F.arrays_zip(
        F.slice("s", F.lit(1), F.size("s") - 1).alias("left"),
        F.slice("s", F.lit(2), F.size("s") - 1).alias("right"),
    )
    return (
        states.select(symbols(F.col("state")).alias("s"), "n")
        .select(F.explode(pairs).alias("p"), "n")
        .where((F.col("p.left") != UNKNOWN) & (F.col("p.right") != UNKNOWN))
        .groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right"))
        .agg(F.sum("n").alias("n"))
    )


@dataclass
class MergeModel:
    """Learned merges in rank order, and the text of every joined symbol."""

    pairs: list[tuple[int, int, int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    texts: dict[int, str] = field(default_factory=dict)
    by_text: dict[str, int] = field(default_factory=dict)

    def text(self, symbol: int) -> str:
        return self.texts.get(symbol) or chr(symbol)

    def add(self, left: int, right: int, n: int) -> bool:
        """Take one merge; False when its text was already a symbol."""
        joined = self.text(left) + self.text(right)
        fresh = joined not in self.by_text
        if fresh:
            number = FIRST_JOINED + len(self.texts)
            self.texts[number], self.by_text[joined] = joined, number
        self.pairs.append((left, right, self.by_text[joined]))
        self.counts.append(n)
        return fresh

    def table(self, spark: SparkSession) -> DataFrame:
        """(rank, left, right, token, n); its length is the number of merges asked for."""
        rows = [
            (i, self.text(left), self.text(right), self.text(joined), n)
            for i, ((left, right, joined), n) in enumerate(zip(self.pairs, self.counts))
        ]
        return spark.createDataFrame(
            rows, "rank bigint, left string, right string, token string, n bigint"
        )

    @classmethod
    def from_table(cls, merges: DataFrame) -> "MergeModel":
        model = cls()
        for row in sorted(L.small_rows(merges, MOST_TOKENS), key=lambda r: r["rank"]):
            ids = [model.by_text.get(t) or ord(t) for t in (row.left, row.right)]
            model.add(*ids, row.n)
        return model


def merge_symbols(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to one piece, lowest rank first and left to right."""
    if len(ids) > _SHORT_PIECE:
        return _merge_long(ids, ranks)
    while len(ids) > 1:
        found = [r for r in map(ranks.get, zip(ids, ids[1:])) if r]
        if not found:
            break
        rank, joined = min(found)
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and ranks.get((ids[i], ids[i + 1])) == (rank, joined):
                out.append(joined)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def _merge_long(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same for a long piece, such as a line without spaces: a queue of pairs."""
    after = [*range(1, len(ids)), -1]
    before = list(range(-1, len(ids) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (ids[i], ids[j]) in ranks:
            heapq.heappush(heap, (ranks[ids[i], ids[j]][0], i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ids[i] != left or ids[j] != right:
            continue
        ids[i], ids[j] = ranks[left, right][1], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        offer(before[i])
        offer(i)
    return [s for s in ids if s >= 0]


def _units(joined: list[int], numbers: dict[int, int], text) -> Iterator[tuple[int | None, str]]:
    """(id, text) of each symbol; neighbours without an id are one unit, with id None."""
    run = ""
    for symbol in joined:
        number = numbers.get(symbol)
        if number is None:
            run += text(symbol)
            continue
        if run:
            yield None, run
            run = ""
        yield number, text(symbol)
    if run:
        yield None, run


def _merge_table(pairs: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs as one number each, in order; their ranks; the joined symbol of every rank."""
    first: dict[int, int] = {}
    for rank, (left, right, _) in enumerate(pairs):
        first.setdefault((left << 32) | right, rank)
    codes = np.array(sorted(first), np.int64)
    ranks = np.array([first[c] for c in codes.tolist()], np.int64)
    return codes, ranks, np.array([joined for *_, joined in pairs], np.int64)


def _ranks_at(symbols: np.ndarray, rows: np.ndarray, at: np.ndarray, table) -> np.ndarray:
    """Rank of the pair that begins at each place, `_NO_RANK` where there is none."""
    codes, ranks, _ = table
    out = np.full(len(at), _NO_RANK)
    if len(codes):
        after = np.minimum(at + 1, len(symbols) - 1)
        pair = (symbols[at] << 32) | symbols[after]
        place = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
        found = (after > at) & (rows[after] == rows[at]) & (codes[place] == pair)
        out[found] = ranks[place[found]]
    return out


def merge_many(symbols: np.ndarray, sizes: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) of many pieces after all merges. In a round every piece takes its lowest rank,
    left to right, and pieces without one are done."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    symbols = symbols.copy()
    best = _ranks_at(symbols, rows, np.arange(len(symbols)), table)
    done = [(rows[:0], symbols[:0])]
    while len(rows):
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        least = np.repeat(np.minimum.reduceat(best, starts), np.diff(np.append(starts, len(rows))))
        going = least != _NO_RANK
        if not going.all():
            done.append((rows[~going], symbols[~going]))
            rows, symbols, best, least = rows[going], symbols[going], best[going], least[going]
            if not len(rows):
                break
        at = np.flatnonzero(best == least)
        # Of overlapping places, every other one from the left.
        heads = np.flatnonzero(np.append(True, np.diff(at) != 1))
        at = at[(np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0]
        symbols[at] = table[2][least[at]]
        kept = np.ones(len(rows), bool)
        kept[at + 1] = False
        symbols, rows, best = symbols[kept], rows[kept], best[kept]
        at = at - np.arange(len(at))
        before = at[at > 0] - 1
        best[at] = _ranks_at(symbols, rows, at, table)
        best[before] = _ranks_at(symbols, rows, before, table)
    rows = np.concatenate([r for r, _ in done])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([s for _, s in done])[order], np.bincount(rows, minlength=len(sizes))


def _merged_pieces(pieces: list[str], mark: str, table, ranks) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) of pieces after all merges: long ones singly, the others together."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(mark)
    alone = np.flatnonzero(sizes > _LONG_PIECE)
    lists = {i: merge_symbols([ord(c) for c in mark + pieces[i]], ranks) for i in alone.tolist()}
    sizes[alone] = 0
    text = "".join([mark + p for i, p in enumerate(pieces) if i not in lists] if lists else [mark + p for p in pieces])
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    symbols, sizes = merge_many(points, sizes, table)
    if lists:
        long = [np.array(lists[i], np.int64) for i in alone.tolist()]
        symbols = np.insert(symbols, np.repeat(np.cumsum(sizes)[alone], [len(x) for x in long]), np.concatenate(long))
        sizes[alone] = [len(x) for x in long]
    return symbols, sizes


def _slices(rows: pa.Array) -> Iterator[pa.Array]:
    """The rows of a batch, in order, in parts of about `_SLICE_BYTES`; a row is never parted."""
    lengths = rows.value_lengths().fill_null(0).to_numpy()
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(rows.flatten()).to_numpy().astype(np.int64) + 1)])
    ends = sizes[np.cumsum(lengths)]
    start = 0
    while start < len(rows):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _SLICE_BYTES, "right"))
        stop = max(stop, start + 1)
        yield rows.slice(start, stop - start)
        start = stop


def _mapped(pieces: Column, model: MergeModel, numbers: dict[int, int], mark: str, kind: str, cell) -> Column:
    """An array with `cell(id, text)` of each unit of an array of pieces, in order.

    Runs where the text is: the merges go to the tasks, which take a few megabytes of pieces at a time and
    merge the distinct ones together, so nothing is shuffled. `numbers` maps symbols to ids.
    """
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (left, right, joined) in enumerate(model.pairs):
        ranks.setdefault((left, right), (rank, joined))
    table = _merge_table(model.pairs)
    texts = dict(model.texts)
    values = pa.int32() if kind == "int" else pa.string()

    def text(symbol: int) -> str:
        return texts.get(symbol) or chr(symbol)

    # Cells of the symbols with an id, after one that stands for none.
    known = sorted(numbers)
    symbols_with_id = np.array([-1, *known], np.int64)
    cells_with_id = pa.array([None, *[cell(numbers[s], text(s)) for s in known]], values)

    def cells_of(distinct: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Cells of pieces in a row; where those of each piece start, and their number."""
        symbols, sizes = _merged_pieces(distinct, mark, table, ranks)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        place = np.minimum(np.searchsorted(symbols_with_id, symbols), len(known))
        lacking = np.flatnonzero(symbols_with_id[place] != symbols)
        flat = cells_with_id.take(pa.array(place))
        if len(lacking):
            # Pieces with unknown characters are written anew, behind the others.
            some = np.unique(np.searchsorted(ends, lacking, "right"))
            anew = [
                [cell(number, spelled) for number, spelled in _units(symbols[starts[i]:ends[i]].tolist(), numbers, text)]
                for i in some.tolist()
            ]
            sizes[some] = [len(cells) for cells in anew]
            starts[some] = len(flat) + np.cumsum(sizes[some]) - sizes[some]
            flat = pa.concat_arrays([flat, pa.array(list(chain.from_iterable(anew)), values)])
        return flat, starts, sizes

    @F.arrow_udf(f"array<{kind}>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for rows in _slices(batch):
                coded = rows.flatten().dictionary_encode()
                yield _gather(*cells_of(coded.dictionary.to_pylist()), coded.indices.to_numpy(), rows)

    return encode(pieces)


def merged_ids(pieces: Column, model: MergeModel, numbers: dict[int, int], unknown: int,
               mark: str = "", runs: dict[str, int] | None = None) -> Column:
    """Vocabulary ids of an array of pieces, in order, in one array, `mark` put before each piece.
    Neighbouring unknown characters of a piece are one id: that of their text in `runs`, else `unknown`."""
    runs = runs or {}
    return _mapped(pieces, model, numbers, mark, "int",
                   lambda number, text: runs.get(text, unknown) if number is None else number)


def merged_texts(pieces: Column, model: MergeModel, numbers: dict[int, int], mark: str = "") -> Column:
    """The same units as texts, unknown ones as they stand in the text."""
    return _mapped(pieces, model, numbers, mark, "string", lambda number, text: text)


def _gather(flat: pa.Array, starts: np.ndarray, sizes: np.ndarray, pieces: np.ndarray, rows: pa.Array) -> pa.Array:
    """The cells of every row's pieces in a row, as one list array."""
    ends = np.concatenate([[0], np.cumsum(sizes[pieces])])
    place = np.arange(ends[-1]) + np.repeat(starts[pieces] - ends[:-1], sizes[pieces])
    counts = rows.value_lengths().fill_null(0).to_numpy()
    offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), flat.take(pa.array(place)),
        mask=rows.is_null() if rows.null_count else None,
    )


def merged_vocab(model: MergeModel, specials: Sequence[str], chars: Sequence[str],
                 chars_first: bool = False) -> list[str]:
    """Tokens in id order: specials, then merges and characters (or the reverse)."""
    joined = list(model.by_text)
    rest = [*chars, *joined] if chars_first else [*joined, *chars]
    return list(dict.fromkeys([*specials, *rest]))


def symbol_numbers(model: MergeModel, vocab: Sequence[str], specials: Sequence[str]) -> dict[int, int]:
    """Symbol -> vocabulary id, of joined symbols and of characters."""
    index = {token: number for number, token in enumerate(vocab)}
    chars = [token for token in vocab if len(token) == 1 and token not in set(specials)]
    return {
        **{ord(char): index[char] for char in chars},
        **{symbol: index[text] for symbol, text in model.texts.items()},
    }
