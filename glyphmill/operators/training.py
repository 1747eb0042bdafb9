"""Learning merges in few rounds over the distinct pieces, equal to one merge at a time.

A round counts all pairs of neighbours and takes the most frequent ones as its frame. Each piece is
cut into runs whose neighbours are pairs of the frame, and the distinct runs, which are few, go to
the driver with their counts. Merging one at a time within these runs gives the same counts as
within all pieces for every pair above the least count of the frame: a pair of symbols meets at
one pair of neighbours of the round's start, and if that is outside the frame, it is no more
frequent than the frame's least. So a round takes merges until the best one falls to that count.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import lookup as L, text as T
from ..session import materialize
from .merges import UNKNOWN, MergeModel, spread

# Pairs in the frame of a round, and distinct runs that the driver takes; a frame with more runs is halved.
FRAME, MOST_RUNS = 256, 20_000
# Rounds between written states.
WRITE_EVERY = 6


def symbol_lists(pieces: DataFrame, chars: Sequence[str] | None = None) -> DataFrame:
    """(ids, n): pieces of two symbols or more as code points; with `chars`, others are UNKNOWN."""
    known = None if chars is None else L.dense_array({ord(c): ord(c) for c in chars}, UNKNOWN, "int")
    points = T.code_points(F.col("piece"), lambda cp: cp if known is None else L.at(known, cp, UNKNOWN))
    return pieces.where(F.length("piece") > 1).select(points.cast("array<int>").alias("ids"), "n")


def _symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rows) of all pieces of a batch."""
    ids = batch.column("ids")
    return ids.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())


def _codes(symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One number for each symbol and the next one; -1 where they are no pair."""
    left, right = symbols[:-1], symbols[1:]
    joined = (rows[:-1] == rows[1:]) & (left != UNKNOWN) & (right != UNKNOWN)
    return np.where(joined, (left << 32) | right, -1)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols, rows = _symbols(batch)
        codes = _codes(symbols, rows)
        at = np.flatnonzero(codes >= 0)
        distinct, place = np.unique(codes[at], return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, place, batch.column("n").to_numpy()[rows[at]])
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(sums)], names=["pair", "n"])


def _runs_of(frame: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, rows = _symbols(batch)
            inside = np.isin(_codes(symbols, rows), frame)
            edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            # A run is handed on as the bytes of its symbols.
            sizes = (stops - starts + 1) * 4
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(ends[-1] // 4) + np.repeat(starts - ends[:-1] // 4, sizes // 4)
            data = symbols[at].astype("<i4")
            runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            table = pa.table({"run": runs, "n": batch.column("n").take(pa.array(rows[starts]))})
            for part in table.group_by("run", use_threads=False).aggregate([("n", "sum")]).to_batches():
                yield pa.RecordBatch.from_arrays([part.column("run").cast(pa.binary()), part.column("n_sum")], names=["run", "n"])

    return work


def _merged(pairs: list[tuple[int, int, int]]):
    """All merges in order, each over all pieces of a batch. Pieces of one symbol are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, rows = _symbols(batch)
            for left, right, joined in pairs:
                at = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right) & (rows[:-1] == rows[1:]))
                if not len(at):
                    continue
                if left == right:
                    # Of overlapping places, every other one from the left.
                    heads = np.flatnonzero(np.append(True, np.diff(at) != 1))
                    at = at[(np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0]
                symbols[at] = joined
                symbols, rows = np.delete(symbols, at + 1), np.delete(rows, at + 1)
            sizes = np.bincount(rows, minlength=batch.num_rows)
            kept = sizes > 1
            ends = np.concatenate([[0], np.cumsum(sizes[kept])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(symbols[kept[rows]], pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("n").filter(pa.array(kept))], names=["ids", "n"])

    return work


class _Runs:
    """The distinct runs of a round on the driver, merged one pair at a time."""

    def __init__(self, runs: list[list[int]], counts: list[int]):
        self.runs, self.counts = runs, counts
        self.sums: dict[tuple[int, int], int] = defaultdict(int)
        self.holders: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, (run, n) in enumerate(zip(runs, counts)):
            for pair in zip(run, run[1:]):
                self.sums[pair] += n
                self.holders[pair].add(i)
        self.queue = [(-n, pair) for pair, n in self.sums.items()]
        heapq.heapify(self.queue)

    def best(self) -> tuple[int, tuple[int, int]] | None:
        """(count, pair) of the most frequent pair; of equal ones that of the older symbols."""
        while self.queue:
            n, pair = self.queue[0]
            if self.sums.get(pair) == -n and n:
                return -n, pair
            heapq.heappop(self.queue)
        return None

    def merge(self, pair: tuple[int, int], joined: int) -> None:
        left, right = pair
        changed = set()
        for i in self.holders.pop(pair):
            run, n = self.runs[i], self.counts[i]
            new, k = [], 0
            while k < len(run):
                if run[k] == left and k + 1 < len(run) and run[k + 1] == right:
                    new.append(joined)
                    k += 2
                else:
                    new.append(run[k])
                    k += 1
            for old in zip(run, run[1:]):
                self.sums[old] -= n
                changed.add(old)
            for made in zip(new, new[1:]):
                self.sums[made] += n
                self.holders[made].add(i)
                changed.add(made)
            self.runs[i] = new
        for touched in changed:
            if self.sums[touched]:
                heapq.heappush(self.queue, (-self.sums[touched], touched))


def _take(model: MergeModel, runs: _Runs, first: tuple[int, int], bound: int, tokens: int, min_count: int) -> int:
    """Add the merges that one-at-a-time merging would choose, as far as the runs can tell; the number.

    A symbol that several merges spell meets its neighbours at several pairs of the round's start,
    each with up to `bound` occurrences outside the runs; a pair with such a symbol is not
    taken, and ends the round when it could be the best one.
    """
    forms: dict[int, int] = defaultdict(lambda: 1)
    unsure: set[int] = set()
    taken = 0
    while len(model.texts) < tokens:
        found = runs.best()
        if not found or found[0] < min_count:
            break
        n, pair = found
        if taken or pair != first:
            most = max(forms.values(), default=1) ** 2
            doubtful = bound and any(s in unsure for s in pair)
            if doubtful or n <= bound * most or (bound and _highest(runs, unsure, forms, bound) >= n):
                break
        before = len(model.texts)
        model.add(*pair, n)
        joined = model.pairs[-1][2]
        if len(model.texts) == before:
            forms[joined] += 1
            unsure.add(joined)
        runs.merge(pair, joined)
        taken += 1
    return taken


def _highest(runs: _Runs, unsure: set[int], forms: dict[int, int], bound: int) -> int:
    """The most that a pair with an unsure symbol may count."""
    if not unsure:
        return 0
    return max(
        (n + bound * forms[a] * forms[b] for (a, b), n in runs.sums.items() if n and (a in unsure or b in unsure)), default=0,
    )


def train_merges(pieces: DataFrame, tokens: int, min_count: int = 1, chars: Sequence[str] | None = None,
                 frame: int = FRAME, most_runs: int = MOST_RUNS) -> MergeModel:
    """Learn merges from (piece, n) until they have made `tokens` new tokens, or no pair occurs
    `min_count` times. With `chars`, other characters join nothing.

    A merge whose text is a token already makes no new one. Each round is three small jobs over the
    distinct pieces; the frame's pairs and its runs, both bounded, reach the driver. Pieces that have
    become one symbol are left out.
    """
    model = MergeModel()
    state = materialize(symbol_lists(spread(pieces), chars), "pieces").persist()
    held, rounds = state, 0
    schema = "ids array<int>, n bigint"
    while len(model.texts) < tokens:
        counted = state.mapInArrow(_pair_sums, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        ranked = counted.where(F.col("n") >= min_count).orderBy(F.desc("n"), "pair").limit(frame + 1).collect()
        if not ranked:
            break
        done, size = len(model.pairs), min(frame, len(ranked))
        first = ranked[0].pair
        while True:
            inside = np.array(sorted(r.pair for r in ranked[:size]), np.int64)
            runs = state.mapInArrow(_runs_of(inside), "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
            found = runs.limit(most_runs + 1).toArrow()
            if found.num_rows <= most_runs or size == 1:
                break
            size //= 2
        # Pairs outside the frame occur at most so often.
        bound = ranked[size].n if size < len(ranked) else min_count - 1
        lists = [np.frombuffer(r, "<i4").tolist() for r in found.column("run").to_pylist()]
        _take(model, _Runs(lists, found.column("n").to_pylist()), (first >> 32, first & 0xFFFFFFFF), bound, tokens, min_count)
        rounds += 1
        now = state.mapInArrow(_merged(model.pairs[done:]), schema)
        state = materialize(now, "pieces") if rounds % WRITE_EVERY == 0 else now
        state.persist()
        if rounds % WRITE_EVERY == 0:
            held.unpersist()
            held = state
    state.unpersist()
    return model
