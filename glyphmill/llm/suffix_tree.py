"""A probabilistic suffix tree over words: contexts of varying length that predict the next word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C, lists as L
from ..session import discard

# A context is looked at if it was seen so often, whatever the size of the corpus.
CONTEXT = 8
# A word is a state's own if it was seen after the state so often.
FOLLOW = 2
SEEN = 2
DEPTH = 4
# Runs of words with this share of all training tokens have their weights sent to the tasks, at most 1 / HOT
# of a length; the others are joined. This decides how a weight is found, not what it is.
HOT = 1e-5
# Bits of the filter that passes over runs without a weight, at most; a full one passes all.
FILTER_BITS = 1 << 27
# Training tokens for each bucket of the runs that are counted or joined.
BUCKET = 1_000_000
# Larger jobs count the runs of a length in so many parts, one after the other, if most runs pass the filters: those
# of single words, and those of contexts whose filter has more than this share of its bits. They score the
# texts in so many parts. Only one part's runs are on disk at a time.
COUNTED_IN, FULL = 2, 0.2
SCORED_IN = 3
# Numbers that a task holds before it lists them by bucket.
HELD = 1_000_000
# A filter is put together in 2 ** PIECES pieces.
PIECES = 6
# A context stays if, over all its places, it saves DIVERGENCE * ln(places) nats against the shorter one.
DIVERGENCE = 2.0
# What is taken off each count, for the words that are not the state's own.
DISCOUNT = 0.5
SMOOTH = 0.1
# Held out: documents whose crc32 is 0 modulo this.
FOLDS = 10

# 64-bit stand-ins of the end of a text and of what comes before its first word.
END, START = np.uint64(0xE000000000000001), np.uint64(0xB000000000000001)


def held_out(key: Column) -> Column:
    """A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, hashes): every text's words in lower case, then its end."""
    words = C.Words(texts, lower=True)
    n = len(texts)
    sizes = words.sizes + 1
    first = np.cumsum(sizes) - sizes
    hashes = np.full(int(sizes.sum()), END, np.uint64)
    hashes[first[words.rows] + words.places] = words.hashes()
    rows = np.repeat(np.arange(n), sizes)
    return rows, np.arange(len(hashes)) - first[rows], hashes


@dataclass
class Tree:
    """Words by number, contexts by number, and what follows each state.

    `words` are the sorted hashes of words that are `follow` or more of all, `counts` theirs. A context of
    length 1 is the number of a word, or `len(words)` for the start of a text; `firsts` marks those that
    are looked at. A longer one has a number by its place in `contexts[length - 2]`, sorted codes of
    (earlier word, shorter context). `next_[length - 1]` are sorted codes of (context, word) with `n`
    and, once the tree is pruned, log10 probabilities; `rest` is the log10 weight of what a context leaves
    to the shorter one, `kept` whether it is a state.
    """

    total: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray | None = None
    contexts: list[np.ndarray] = field(default_factory=list)
    next_: list[np.ndarray] = field(default_factory=list)
    n: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)

    @property
    def span(self) -> int:
        return len(self.words) + 1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words; -1 for the others."""
        return _places(self.words, hashes)

    def context_numbers(self, numbers: np.ndarray, places: np.ndarray, depth: int) -> list[np.ndarray]:
        """Per length, the number of the context before each token; -1 where there is none."""
        before = np.full(len(numbers), -1, np.int64)
        before[1:] = numbers[:-1]
        before[places == 0] = len(self.words)
        one = np.where((before >= 0) & self.firsts[before], before, -1)
        out = [one]
        for length in range(2, depth + 1):
            shorter, earlier = out[-1], np.full(len(numbers), -1, np.int64)
            step = length - 1
            earlier[step:] = before[:-step]
            earlier[places < step] = -1
            codes = np.where((shorter >= 0) & (earlier >= 0), shorter * self.span + earlier, -1)
            out.append(_places(self.contexts[length - 2], codes))
        return out


def _places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(values), -1, np.int64)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[place] == values, place, -1)


def _counted(texts: DataFrame, codes_of) -> DataFrame:
    """(code, n) summed over the training texts; tasks sum what they have before it moves."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            codes = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            codes, place = np.unique(codes, return_inverse=True)
            return codes, np.bincount(place, weights=counts, minlength=len(codes)).astype(np.int64)

        def batch_of(codes, counts):
            return pa.RecordBatch.from_arrays([C.signed(codes), pa.array(counts)], names=["code", "n"])

        for batch in C.chunks(batches, "text"):
            held.append(np.unique(codes_of(*tokens(batch.column("text"))), return_counts=True))
            if sum(len(h[0]) for h in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield batch_of(*held.pop())
        if held:
            yield batch_of(*merged())

    return texts.mapInArrow(mapped, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes at least that frequent, in order: at most the total over `least` of them."""
    rows = counts.where(F.col("n") >= least).toPandas()
    codes = rows["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], rows["n"].to_numpy(np.int64)[order]


def fit(texts: DataFrame, depth: int, context: float, follow: float,
        divergence: float = DIVERGENCE) -> tuple[Tree, DataFrame]:
    """The tree of a small corpus, held whole, and the counts of all its tokens (code, n). `context` and
    `follow` are shares of all tokens. `scores` does not use it: it is what its tables are tested against.
    """
    counts = C.staged(_counted(texts, lambda rows, places, hashes: hashes), "tokens")
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"] or 0, size["v"]
    least = max(SEEN, follow * total)
    tree = Tree(total, distinct, *_frequent(counts, least))
    enough = max(SEEN, context * total)
    starts = int(tree.counts[tree.words == END].sum())  # every text has one end and one start
    tree.firsts = np.append(tree.counts >= enough, starts >= enough)
    for length in range(1, depth + 1):
        def codes_of(rows, places, hashes, length=length):
            numbers = tree.numbers(hashes)
            contexts = tree.context_numbers(numbers, places, length)[-1]
            use = (contexts >= 0) & (numbers >= 0)
            return (contexts[use] * tree.span + numbers[use]).astype(np.uint64)

        counted = C.staged(_counted(texts, codes_of), "followers")
        # What follows a context in all, for its words that are not its own too.
        codes, n = _frequent(counted, least)
        tree.next_.append(codes.astype(np.int64))
        tree.n.append(n)
        if length == 1:
            tree.sums.append(np.append(tree.counts, starts))
        if length < depth:
            # The words of a longer context: a shorter one's last word, and one more before it.
            pairs = np.flatnonzero(n >= enough)
            shorter, word = codes[pairs].astype(np.int64) // tree.span, codes[pairs].astype(np.int64) % tree.span
            tree.contexts.append(_longer(tree, length, shorter, word, n[pairs]))
    _prune(tree, divergence)
    return tree, counts


def _longer(tree: Tree, length: int, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Codes of the contexts (context, word), read as a context of one word more that ends in `word`;
    those whose end is itself a context. Adds their counts to the tree's sums."""
    words = _spelled(tree, length, context)
    words.append(word)
    shorter = np.where(tree.firsts[words[-1]], words[-1], -1)
    for level in range(2, length + 1):
        codes = np.where(shorter >= 0, shorter * tree.span + words[-level], -1)
        shorter = _places(tree.contexts[level - 2], codes)
    use = shorter >= 0
    codes = shorter[use] * tree.span + words[-length - 1][use]
    order = np.argsort(codes)
    tree.sums.append(n[use][order])
    return codes[order]


def _spelled(tree: Tree, length: int, context: np.ndarray) -> list[np.ndarray]:
    """The words of contexts, earliest first."""
    words = []
    for level in range(length, 1, -1):
        codes = tree.contexts[level - 2][context]
        words.append(codes % tree.span)
        context = codes // tree.span
    return [*words, context]


def _prune(tree: Tree, divergence: float) -> None:
    """Keep the contexts that predict otherwise than the shorter ones, and those that these end in."""
    depth, cutoff = len(tree.next_), divergence * np.log(max(tree.total, 2))
    base = np.log10((tree.counts + SMOOTH) / (tree.total + SMOOTH * (tree.distinct + 1)))
    parents = [np.full(len(tree.sums[0]), -1, np.int64)]
    parents += [codes // tree.span for codes in tree.contexts]
    for level in range(depth):
        context, word = tree.next_[level] // tree.span, tree.next_[level] % tree.span
        n, sums = tree.n[level], np.maximum(tree.sums[level], 1)
        share = np.maximum(n - DISCOUNT, 0) / sums[context]
        if level == 0:
            parent = base[word]
        else:
            codes = parents[level][context] * tree.span + word
            place = _places(tree.next_[level - 1], codes)
            up = parents[level][context]
            grand = base[word] if level == 1 else _state_logs(tree, level - 2, parents[level - 1][up], word, base, parents)
            parent = np.where(place >= 0, tree.logs[level - 1][place], tree.rest[level - 1][up] + grand)
        own = np.bincount(context, weights=share, minlength=len(sums))
        there = np.bincount(context, weights=10.0 ** parent, minlength=len(sums))
        left = np.maximum(1 - own, 1e-9) / np.maximum(1 - there, 1e-9)
        saved = np.bincount(
            context, weights=n * (np.log(np.maximum(share, 1e-300)) - parent * np.log(10)), minlength=len(sums)
        ) + np.maximum(sums * (1 - own), 0) * np.log(np.maximum(left, 1e-300))
        tree.logs.append(np.log10(np.maximum(share, 1e-300)))
        tree.rest.append(np.log10(np.maximum(left, 1e-300)))
        tree.kept.append(saved >= cutoff)
    for level in range(depth - 1, 0, -1):
        ends = parents[level][tree.kept[level]]
        tree.kept[level - 1][ends] = True
    for level in range(depth):
        # What is no state hands everything on to the shorter context.
        gone = ~tree.kept[level]
        tree.rest[level][gone] = 0.0
        stay = tree.kept[level][tree.next_[level] // tree.span]
        tree.next_[level], tree.logs[level] = tree.next_[level][stay], tree.logs[level][stay]


def _state_logs(tree, level, contexts, words, base, parents):
    """Log10 probability of words after contexts of one length, as far as the tree is made."""
    place = _places(tree.next_[level], contexts * tree.span + words)
    shorter = base[words] if level == 0 else _state_logs(tree, level - 1, parents[level][contexts], words, base, parents)
    return np.where(place >= 0, tree.logs[level][place], tree.rest[level][contexts] + shorter)


def _scored(tree: Tree, depth: int):
    """Per row its token count and the sums that need no rare word; then its rare words."""
    scale = np.log10(tree.total + SMOOTH * (tree.distinct + 1))
    base = np.log10(tree.counts + SMOOTH) - scale

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text"):
            rows, places, hashes = tokens(batch.column("text"))
            size = batch.num_rows
            numbers = tree.numbers(hashes)
            known = numbers >= 0
            single = np.where(known, base[numbers] if len(base) else 0.0, 0.0)
            value, done = np.zeros(len(rows)), np.zeros(len(rows), bool)
            contexts = tree.context_numbers(numbers, places, depth)
            for level in range(depth - 1, -1, -1):
                at = contexts[level]
                inside = at >= 0
                state = inside.copy()
                state[inside] = tree.kept[level][at[inside]]
                open_ = state & ~done
                code = np.where(open_ & known, at * tree.span + numbers, -1)
                place = _places(tree.next_[level], code)
                hit = place >= 0
                if len(tree.logs[level]):
                    value[hit] += tree.logs[level][place[hit]]
                done |= hit
                more = open_ & ~hit
                value[more] += tree.rest[level][at[more]]
            value += np.where(done, 0.0, single)
            ids = batch.column("_row").to_numpy()
            sums = [np.bincount(rows, minlength=size), np.bincount(rows[known], minlength=size)]
            floats = [np.bincount(rows, weights=w, minlength=size) for w in (single, value)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.nulls(size, pa.int64()), *[pa.array(x, pa.int64()) for x in sums],
                 *map(pa.array, floats)], names=["_row", "code", "n", "n_known", "base", "score"],
            )
            rare = ~known
            pairs = np.stack([rows[rare], hashes[rare].view(np.int64)])
            order = np.lexsort((pairs[1], pairs[0]))
            pairs = pairs[:, order]
            first = np.ones(pairs.shape[1], bool)
            first[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, pairs.shape[1]))
            zeros = np.zeros(len(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[pairs[0, at]]), pa.array(pairs[1, at]), pa.array(n, pa.int64()),
                 pa.array(zeros.astype(np.int64)), pa.array(zeros), pa.array(zeros)],
                names=["_row", "code", "n", "n_known", "base", "score"],
            )

    return work


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, codes, sizes): the ids of the distinct tokens, the most frequent first, the code of each token
    of START, the words, END of every text, and each text's number of them."""
    words = C.Words(texts, lower=True)
    sizes = words.sizes + 2
    first = np.cumsum(sizes) - sizes
    ids, code = np.unique(np.concatenate([np.array([START, END]), words.table()]), return_inverse=True)
    codes = np.full(int(sizes.sum()), code[0])
    codes[first + sizes - 1] = code[1]
    # Each text has a start and an end before the next one's words.
    codes[np.arange(len(words.codes)) + 2 * words.rows + 1] = code[2:][words.codes]
    counts = np.bincount(codes, minlength=len(ids))
    # Those of one number stay in the order of their ids. The empty word comes in no text.
    order = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(order))
    return ids[order], place[codes], sizes


class Runs:
    """The runs of tokens in a chunk of texts, by the places where they start. The id of a run is made of those
    of the run without its last and without its first token."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, codes: np.ndarray):
        self.rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.ids = words[codes]
        self.words, self.codes = words, codes

    @cached_property
    def pairs(self) -> np.ndarray:
        return C.mix((self.words * np.uint64(C._BASE))[self.codes[:-1]] + C.mix(self.words)[self.codes[1:]])

    def at(self, length: int, places: np.ndarray) -> np.ndarray:
        if length < 3:
            return (self.ids, self.pairs)[length - 1][places]
        return run_ids(self.at(length - 1, places), self.at(length - 1, places + 1))

    def whole(self, length: int, places: np.ndarray) -> np.ndarray:
        """The places whose runs end within their text."""
        places = places[:np.searchsorted(places, len(self.rows) - length, side="right")]
        return places[self.rows[places] == self.rows[places + length - 1]]

    def both(self, length: int, places: np.ndarray) -> np.ndarray:
        """The places whose runs of `length` tokens are made of two that start at `places`."""
        there = np.zeros(len(self.ids) + 1, bool)
        there[places] = True
        return self.whole(length, places[there[places + 1]])

    def passing(self, filters: list[np.ndarray | None]) -> np.ndarray:
        """The places of the runs as long as there are filters that pass the last one; as do all parts
        of them the one of their length, if there is one."""
        places = np.flatnonzero(_passed(filters[0], self.words)[self.codes])
        for length, table in enumerate(filters[1:], 2):
            places = self.both(length, places)
            if table is not None:
                places = places[_passed(table, self.at(length, places))]
        return places


def run_ids(prefixes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    return C.mix(prefixes * np.uint64(C._BASE) + C.mix(suffixes))


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits by the first bits of ids: an id whose bit is not set is not among them. They are numbers in rows, or in
    lists, or those of the runs whose contexts and suffixes are in lists."""
    bits = _filter_bits(_numbers_in(ids) if ids.dtypes[0][1] == "binary" else ids.count())
    each = bits - PIECES  # a piece of the bits at a time

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(held):
            places = np.sort(np.concatenate(held))
            return pa.RecordBatch.from_arrays(L.listed(places >> np.uint32(each), places), names=["piece", "places"])

        held, size = [], 0
        for batch in batches:
            if pa.types.is_binary(batch.column(0).type):
                x = [L.flat(pa.chunked_array([c]), np.uint64) for c in batch.columns]
            else:
                x = [batch.column(0).to_numpy().view(np.uint64)]
            x = x[0] if len(x) == 1 else run_ids(*x)
            held.append((x >> np.uint64(64 - bits)).astype(np.uint32))
            size += len(x)
            if size >= HELD:
                yield lists(held)
                held, size = [], 0
        if size:
            yield lists(held)

    def marked(lists: pa.Table) -> pa.Table:
        there = np.zeros(1 << each, bool)
        there[L.flat(lists.column("places"), np.uint32) & np.uint32((1 << each) - 1)] = True
        return pa.table({
            "piece": lists.column("piece")[:1], "bits": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())})

    lists = ids.mapInArrow(mapped, "piece int, places binary")
    table = np.zeros(1 << (bits - 6), np.uint64)
    for row in lists.groupBy("piece").applyInArrow(marked, "piece int, bits binary").toArrow().to_pylist():
        own = np.frombuffer(row["bits"], np.uint8)
        table.view(np.uint8)[row["piece"] * len(own):][:len(own)] = own
    return table


def _numbers_in(lists: DataFrame) -> int:
    return (lists.agg(F.sum(F.length(lists.columns[0])).alias("n")).first()["n"] or 0) // 8


def _filter_bits(n: int) -> int:
    return min(max(int(16 * n).bit_length(), 10), FILTER_BITS.bit_length() - 1)


def _filter_of(ids: np.ndarray) -> np.ndarray:
    """The same for ids at hand."""
    bits = _filter_bits(len(ids))
    table, place = np.zeros(1 << (bits - 6), np.uint64), ids >> np.uint64(64 - bits)
    np.bitwise_or.at(table, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    return table


def _passed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids >> np.uint64(64 - (len(table).bit_length() + 5))
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _followers(texts: DataFrame, length: int, candidates: np.ndarray, ends: np.ndarray) -> DataFrame:
    """(context, suffix, n) of the runs of `length` words and a token after them whose context passes
    `candidates` and whose run without its first word passes `ends`."""
    texts = _numbered(texts.select(F.lit(0).cast("bigint").alias("_row"), F.lit(True).alias("train"), "text"))
    every = np.full(1 << 4, ~np.uint64(0))
    filters = [every] * (length - 1) + [candidates]
    lists = _followed(texts, Here((filters, ends)), 1)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(_numbers(batch, c).view(np.int64)) for c in ("context", "suffix", "n")], names=["context", "suffix", "n"])

    return lists.select("context", "suffix", "n").mapInArrow(mapped, "context bigint, suffix bigint, n bigint")


@dataclass
class Here:
    """A value that travels with a function; a broadcast one can be removed before the job's end."""

    value: object


_WORDS = "chunk bigint, train boolean, n bigint, rows binary, sizes binary, words binary, counts binary, codes binary"


def _numbered(texts: DataFrame) -> DataFrame:
    """Texts (_row, train, text) as numbers, a chunk of them in a row: the keys of its texts and their numbers of
    tokens; its distinct words, how often they come, and the code of each token. Words are cut and hashed once;
    whatever reads the texts again reads this."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        names = ["chunk", "train", "n", "rows", "sizes", "words", "counts", "codes"]
        for batch in C.chunks(C.released(batches), "text"):
            for train in (True, False):
                part = batch.filter(pc.equal(batch.column("train"), train))
                if not part.num_rows:
                    continue
                words, codes, sizes = spelled(part.column("text"))
                counts = np.bincount(codes, minlength=len(words))
                blobs = [L.pressed(x) for x in (
                    part.column("_row").to_numpy(), sizes.astype(np.int64), words, counts.astype(np.int64),
                    codes.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | k << 1 | train]), pa.array([train]), pa.array([len(codes)]), *[pa.array([x], pa.binary()) for x in blobs]],
                    names=names,
                )
            k += 1

    return texts.mapInArrow(mapped, _WORDS)


def _words(texts: DataFrame, buckets: int) -> DataFrame:
    """(code, n) of all tokens, starts too."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words"), batch.column("counts")):
                codes = L.opened(words.as_py(), np.uint64)
                order = np.argsort(codes)
                lists = L.listed(L.bucket_of(codes[order], buckets), codes[order], L.opened(counts.as_py(), np.int64)[order])
                yield pa.RecordBatch.from_arrays(lists, names=["bucket", "code", "n"])

    def summed(lists: pa.Table) -> pa.Table:
        codes = L.flat(lists.column("code"), np.uint64)
        order, first = L.groups(codes)
        n = L.sums(L.flat(lists.column("n"), np.int64)[order], first)
        return pa.table({"code": C.signed(codes[order[first]]), "n": n})

    lists = texts.select("words", "counts").mapInArrow(mapped, "bucket int, code binary, n binary")
    return lists.groupBy("bucket").applyInArrow(summed, "code bigint, n bigint")


def _followed(texts: DataFrame, filters: Here | Broadcast, least: int, buckets: int = 1, part: int = 0,
              parts: int = 1, more: bool = False) -> DataFrame:
    """Lists (length, context, suffix, n), by context, of the runs of some words, as many as `length`, and a token
    after them, seen `least` times or more; those of one of `parts` parts by first word. `filters` are those
    that the words must pass, as do their parts, one for each length; and one, or none, for the run without
    its first word. With `more`, runs with one word more too, if both parts of their words pass."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates, ends = filters.value
        for batch in C.released(batches):
            for sizes, words, codes in zip(*[batch.column(c) for c in ("sizes", "words", "codes")]):
                words, codes = L.opened(words.as_py(), np.uint64), L.opened(codes.as_py(), np.uint32)
                runs = Runs(L.opened(sizes.as_py(), np.int64), words, codes)
                mine = words % np.uint64(parts) == part
                places = runs.passing(candidates)
                for length in range(len(candidates), len(candidates) + 1 + more):
                    if length > len(candidates):
                        places = runs.both(length, places)
                    at = places[mine[codes[places]]] if parts > 1 else places
                    at = runs.whole(length + 1, at)
                    suffixes = runs.at(length, at + 1)
                    if length == len(candidates) and ends is not None:
                        use = np.flatnonzero(_passed(ends, suffixes))
                        at, suffixes = at[use], suffixes[use]
                    contexts = runs.at(length, at)
                    ids = run_ids(contexts, suffixes)
                    order, first = L.groups(ids)
                    place = order[first]
                    n = np.diff(np.append(first, len(order))).astype(np.uint32)
                    bucket, *lists = L.listed(L.bucket_of(ids[place], buckets), contexts[place], suffixes[place], n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(bucket), length, np.int32)), bucket, *lists],
                        names=["length", "bucket", "context", "suffix", "n"])

    def summed(lists: pa.Table) -> pa.Table:
        contexts, suffixes = [L.flat(lists.column(c), np.uint64) for c in ("context", "suffix")]
        codes = run_ids(contexts, suffixes)
        order, first = L.groups(codes)
        n = L.sums(L.flat(lists.column("n"), np.uint32)[order].astype(np.int64), first)
        place = order[first[n >= least]]
        out = _relisted(contexts[place], buckets, ("context", "suffix", "n"), contexts[place], suffixes[place], n[n >= least])
        return out.add_column(0, "length", pa.array(np.full(len(out), lists.column("length")[0].as_py(), np.int32)))

    schema = "length int, bucket int, context binary, suffix binary, n binary"
    lists = texts.select("sizes", "words", "codes").mapInArrow(mapped, schema)
    return lists.groupBy("length", "bucket").applyInArrow(summed, schema)


def _relisted(codes: np.ndarray, buckets: int, names: tuple[str, ...], *columns: np.ndarray) -> pa.Table:
    """The columns as lists by the bucket of the codes, in the order of the codes."""
    order = np.argsort(codes)
    return pa.table(L.listed(L.bucket_of(codes[order], buckets), *[x[order] for x in columns]), names=["bucket", *names])


def _lists(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of numbers as lists by the bucket of `code`."""
    names = tuple(rows.columns)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(held):
            columns = [np.concatenate(x) for x in zip(*held)]
            return _relisted(columns[names.index("code")].view(np.uint64), buckets, names, *columns).to_batches()

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            size += batch.num_rows
            if size >= HELD:
                yield from lists(held)
                held, size = [], 0
        if size:
            yield from lists(held)

    return rows.mapInArrow(mapped, ", ".join(["bucket int", *[f"{c} binary" for c in names]]))


def _of_own(own: DataFrame, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(contexts, shorter) for the next length: lists (code, up, sum) of the runs seen `least` times or more, and
    (code, log) of all."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "context"):
            context, suffix, n = [_numbers(batch, c) for c in ("context", "suffix", "n")]
            use = n >= least
            codes = run_ids(context[use], suffix[use])
            yield from _relisted(codes, buckets, ("code", "up", "sum"), codes, suffix[use], n[use]).to_batches()

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "context"):
            context, suffix, n, total = [_numbers(batch, c) for c in ("context", "suffix", "n", "sum")]
            codes = run_ids(context, suffix)
            yield from _relisted(codes, buckets, ("code", "log"), codes, _share(n, total)).to_batches()

    return (
        own.select("context", "suffix", "n").mapInArrow(contexts, "bucket int, code binary, up binary, sum binary"),
        own.select("context", "suffix", "n", "sum").mapInArrow(shorter, "bucket int, code binary, log binary"),
    )


_KINDS = {"n": np.int64, "sum": np.int64, "log": np.float64, "before": np.float64, "rest": np.float64, "score": np.float64}


def _numbers(lists: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    x = lists.column(column)
    return L.flat(x if isinstance(x, pa.ChunkedArray) else pa.chunked_array([x]), _KINDS.get(column, np.uint64))


def _ordered(lists: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns of lists, in the order of the first."""
    out = [_numbers(lists, c) for c in columns]
    order = np.argsort(out[0])
    return [x[order] for x in out]


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum((n - DISCOUNT) / np.maximum(total, 1), 1e-300))


def _own(found: DataFrame, contexts: DataFrame, shorter: DataFrame, buckets: int) -> DataFrame:
    """`found` with the counts of their contexts and what the runs without their first word have; lists by context."""
    names = ("context", "suffix", "n", "sum", "before")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, total = _ordered(right, "code", "sum")
        context, suffix, n = [_numbers(left, c) for c in names[:3]]
        place = _places(codes, context)
        use = np.flatnonzero(place >= 0)  # the others passed the filter by chance
        return _relisted(suffix[use], buckets, names[:4], context[use], suffix[use], n[use], total[place[use]])

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, log = _ordered(right, "code", "log")
        context, suffix, n, total = [_numbers(left, c) for c in names[:4]]
        place = _places(codes, suffix)
        use = np.flatnonzero(place >= 0)
        return _relisted(context[use], buckets, names, *[x[use] for x in (context, suffix, n, total)], log[place[use]])

    schema = ["bucket int", *[f"{c} binary" for c in names]]
    counted = found.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(summed, ", ".join(schema[:-1]))
    return counted.groupBy("bucket").cogroup(shorter.groupBy("bucket")).applyInArrow(held, ", ".join(schema))


def _states(own: DataFrame, contexts: DataFrame, cutoff: float) -> DataFrame:
    """(context, up, sum, rest, kept) of the contexts that have words of their own."""
    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, up = _ordered(right, "code", "up")
        context, n, total, before = _ordered(left, "context", "n", "sum", "before")
        log = _share(n, total)
        _, first = L.groups(context)
        own_, there, gain = [L.sums(x, first) for x in (10.0 ** log, 10.0 ** before, n * (log - before))]
        left_ = np.log(np.maximum(1 - own_, 1e-9) / np.maximum(1 - there, 1e-9))
        context, total = context[first], total[first]
        saved = gain * np.log(10) + np.maximum(total * (1 - own_), 0.0) * left_
        return pa.table({
            "context": C.signed(context), "up": C.signed(up[_places(codes, context)]), "sum": total,
            "rest": left_ / np.log(10), "kept": saved >= cutoff,
        })

    return own.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(
        judged, "context bigint, up bigint, sum bigint, rest double, kept boolean")


def _own_weights(own: DataFrame, kept: DataFrame, often: float, buckets: int) -> DataFrame:
    """Lists of the weights of the runs whose contexts are kept."""
    def weighed(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, rest = _ordered(right, "code", "rest")
        context, suffix, n, total, before = [_numbers(left, c) for c in ("context", "suffix", "n", "sum", "before")]
        place = _places(codes, context)
        use = np.flatnonzero(place >= 0)
        score = _share(n[use], total[use]) - before[use] - rest[place[use]]
        return _weights(run_ids(context[use], suffix[use]), n[use], np.zeros(len(use), np.int64), score, often, buckets)

    lists = own.groupBy("bucket").cogroup(kept.groupBy("bucket"))
    return lists.applyInArrow(weighed, "bucket int, code binary, n binary, score binary")


def _weights(codes: np.ndarray, c: np.ndarray, n: np.ndarray, score: np.ndarray, often: float, buckets: int) -> pa.Table:
    """Weights as lists by bucket; those with `c` of `often` or more have the bucket -1."""
    bucket = np.where(c >= often, -1, L.bucket_of(codes, buckets).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    return pa.table(L.listed(bucket[order], codes[order], n[order], score[order]), names=["bucket", "code", "n", "score"])


def _signed(code: np.uint64) -> int:
    return int(np.array([code], np.uint64).view(np.int64)[0])


def _weight_lists(rows: DataFrame, often: float, buckets: int) -> DataFrame:
    """Rows (code, c, n, score) as lists of weights."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(held):
            codes, *columns = [np.concatenate(x) for x in zip(*held)]
            return _weights(codes.view(np.uint64), *columns, often, buckets).to_batches()

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("code", "c", "n", "score")])
            size += batch.num_rows
            if size >= HELD:
                yield from lists(held)
                held, size = [], 0
        if size:
            yield from lists(held)

    return rows.select("code", "c", "n", "score").mapInArrow(mapped, "bucket int, code binary, n binary, score binary")


def _weights_of(lists: pa.Table) -> tuple[np.ndarray, ...]:
    """(codes, known, base, score) of lists of weights, each code once and in order."""
    codes, n, score = _ordered(lists, "code", "n", "score")
    _, first = L.groups(codes)
    n, score = L.sums(n, first), L.sums(score, first)
    base = np.where(n > 0, np.log10(n + SMOOTH) - np.log10(SMOOTH), 0.0)
    return codes[first], (n > 0).astype(np.float64), base, base + score


@dataclass
class Grown:
    """A tree in tables: the training tokens, the distinct ones, the lists of weights by bucket, per length a
    filter of the contexts that are states, and a filter of the runs in the lists."""

    total: int
    distinct: int
    buckets: int
    weights: DataFrame
    states: list[np.ndarray]
    weighted: np.ndarray


def grow(texts: DataFrame, depth: int = DEPTH, context: int = CONTEXT, follow: int = FOLLOW,
         divergence: float = DIVERGENCE) -> Grown:
    """The tree of the training texts among `texts` (`_numbered`). Its weights are of the runs of words that
    change a score.

    Grown by length: contexts seen `context` times or more, and what follows them `follow` times or
    more, are counted, held against the shorter context, and kept if they diverge or if a kept one ends
    in them. All of it stays in tables that grow with the corpus; a table goes when nothing reads it any more.
    A token's log10 probability is the sum, over the runs of words that end before it or in it, of what they
    add: a kept context adds the weight it leaves to the shorter one; a run whose last word is such a
    context's own adds the difference between its share and what it would have had so far.
    """
    texts = texts.where("train")
    buckets = 1 + (texts.agg(F.sum("n").alias("n")).first()["n"] or 0) // BUCKET
    start, end = F.lit(_signed(START)), F.lit(_signed(END))
    tokens_ = C.staged(_words(texts, buckets), "tokens")
    words = tokens_.where(F.col("code") != start)
    size = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"] or 0, size["v"]
    scale = float(np.log10(total + SMOOTH * (distinct + 1)))
    least, enough = max(SEEN, follow), max(SEEN, context)
    # The lists of a length: its runs with log10 of the share (of all tokens, for single words).
    shorter = _lists(words.where(F.col("n") >= least).select("code", (F.log10(F.col("n") + SMOOTH) - scale).alias("log")), buckets)
    contexts = _lists(tokens_.where((F.col("code") != end) & (F.col("n") >= enough)).select(
        "code", F.lit(0).cast("bigint").alias("up"), F.col("n").alias("sum")
    ), buckets)
    ends = words.where(F.col("n") >= least).select("code")
    levels, states, candidates, found = [], [], [], []
    for length in range(1, max(depth, 0) + 1):
        contexts = C.staged(contexts, "contexts")
        counted, found = found, []
        if counted:
            candidates.append(None)
        else:
            # A run is not seen more often than what it ends in, so only runs that end in one of `shorter` move.
            # From the third length on nearly all others do, too.
            candidates.append(_filter(contexts.select("code")))
            filters = texts.sparkSession.sparkContext.broadcast((candidates, _filter(ends) if length < 3 else None))
            # Where most runs move, one part of them after the other; few do from the third length on, and two
            # lengths are counted at a time.
            full = np.bitwise_count(candidates[-1]).sum() > 64 * FULL * len(candidates[-1])
            parts = COUNTED_IN if total > BUCKET and (length == 1 or full) else 1
            more = 3 <= length < depth
        own = None
        for part in range(parts):
            table = counted[part] if counted else C.staged(_followed(texts, filters, least, buckets, part, parts, more), "found")
            joined = C.staged(_own(table.where(F.col("length") == length), contexts, shorter, buckets), "own")
            if more and not counted:
                found.append(table)
            else:
                discard(table)
            own = joined if own is None else own.unionByName(joined)
        if not counted:
            filters.destroy()
        states.append(C.staged(_states(own, contexts, divergence * float(np.log(max(total, 2)))), "states"))
        levels.append(own)
        discard(contexts)
        contexts, shorter = _of_own(own, enough, buckets)
        ends = own.select("context", "suffix")
    none = F.lit(0).cast("bigint").alias("n")
    lists, kept, filters = [], None, []
    for own, state in zip(reversed(levels), reversed(states)):
        now = state.where("kept")
        if kept is not None:
            ends = kept.select(F.col("up").alias("_end")).distinct()
            now = now.unionByName(state.where("not kept").join(ends, F.col("context") == F.col("_end"), "left_semi"))
        now = C.staged(now, "kept")
        discard(state, *[kept] * (kept is not None))
        kept = now
        filters.insert(0, _filter(kept.select("context")))
        rows = kept.select(F.col("context").alias("code"), F.col("sum").alias("c"), none, F.col("rest").alias("score"))
        lists.append(C.staged(_weight_lists(rows, HOT * total, buckets), "weights"))
        known = _lists(kept.select(F.col("context").alias("code"), "rest"), buckets)
        lists.append(C.staged(_own_weights(own, known, HOT * total, buckets), "weights"))
        discard(own)
    runs_ = lists[0] if lists else None
    for x in lists[1:]:
        runs_ = runs_.unionByName(x)
    weighted = _filter_of(np.empty(0, np.uint64))
    if lists:
        weighted = _filter(runs_.select("code"))
    rows = words.select("code", F.col("n").alias("c"), "n", F.lit(0.0).alias("score"))
    weights = C.staged(_weight_lists(rows, HOT * total, buckets), "weights")
    discard(tokens_, *[kept] * (kept is not None))
    return Grown(total, distinct, buckets, weights.unionByName(runs_) if lists else weights, filters, weighted)


def _weighed(depth: int, tree: Here | Broadcast, buckets: int):
    """A chunk of texts at a time: by bucket, the texts and codes of its runs whose weights are to be joined; and
    per text its key, its token count and the sums of the weights at hand. `tree` has the hot weights, the
    filters of states and the one of the weights of runs."""
    names = ["bucket", "chunk", "docs", "code", "ids", "n", "known", "base", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, *weights), states, weighted = tree.value
        likely = _filter_of(hot)

        def summed(places, rows, size):
            return [np.bincount(rows, minlength=size, weights=w[places]) for w in weights]

        for batch in C.released(batches):
            for chunk, keys, sizes, words, codes in zip(*[batch.column(c) for c in ("chunk", "rows", "sizes", "words", "codes")]):
                chunk, sizes, words = chunk.as_py(), L.opened(sizes.as_py(), np.int64), L.opened(words.as_py(), np.uint64)
                codes, size = L.opened(codes.as_py(), np.uint32), len(sizes)
                runs = Runs(sizes, words, codes)
                place = _places(hot, words)[codes]
                hit = np.flatnonzero(place >= 0)
                sums = summed(place[hit], runs.rows[hit], size)
                # Whether a run may be a state. A state's end is one too, and what has a weight is a state or one
                # and a word after it.
                alive = (_passed(states[0], words) if depth else np.zeros(len(words), bool))[codes]
                rest = np.flatnonzero((place < 0) & (alive | (runs.ids != START)))
                far_docs, far_codes = [runs.rows[rest]], [runs.ids[rest]]
                for length in range(2, depth + 2):
                    places = runs.whole(length, np.flatnonzero(alive[:-1] | alive[1:]))
                    ids, ends, alive = runs.at(length, places), alive[places + 1], np.zeros(len(alive), bool)
                    if length <= depth:
                        ends = np.flatnonzero(ends)
                        alive[places[ends[_passed(states[length - 1], ids[ends])]]] = True
                    use = np.flatnonzero(_passed(weighted, ids))
                    docs, ids = runs.rows[places[use]], ids[use]
                    near = np.flatnonzero(_passed(likely, ids))
                    place = _places(hot, ids[near])
                    hit = near[place >= 0]
                    sums = [a + b for a, b in zip(sums, summed(place[place >= 0], docs[hit], size))]
                    rest = np.ones(len(ids), bool)
                    rest[hit] = False
                    far_docs.append(docs[rest])
                    far_codes.append(ids[rest])
                docs, found = np.concatenate(far_docs).astype(np.uint32), np.concatenate(far_codes)
                order = np.argsort(found)
                docs, found = docs[order], found[order]
                bucket, *lists = L.listed(L.bucket_of(found, buckets), docs, found)
                yield pa.RecordBatch.from_arrays(
                    [bucket, pa.array(np.full(len(bucket), chunk)), *lists, *[pa.nulls(len(bucket), pa.binary())] * 5], names=names)
                # As many to each bucket.
                given = [L.opened(keys.as_py(), np.int64), sizes - 1, *sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(chunk + (chunk >> 32)) % buckets], pa.int32()), pa.array([chunk]), *[pa.nulls(1, pa.binary())] * 2,
                     *[pa.array([x.tobytes()], pa.binary()) for x in given]], names=names)

    return work


def _joined(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums per chunk and text of a bucket's runs with their weights; and the rows that come with sums."""
    runs_, given = left.filter(left.column("code").is_valid()), left.filter(left.column("code").is_null())
    codes, *weights = _weights_of(right)
    place = _places(codes, L.flat(runs_.column("code"), np.uint64))
    hit = np.flatnonzero(place >= 0)
    docs, sizes = L.flat(runs_.column("docs"), np.uint32).astype(np.int64), L.sizes(runs_.column("docs"), np.uint32)
    # A place for each text of each list.
    wide = np.maximum.reduceat(docs, np.cumsum(sizes) - sizes) + 1 if len(docs) else sizes
    first = np.cumsum(wide) - wide
    at = (np.repeat(first, sizes) + docs)[hit]
    there = np.flatnonzero(np.bincount(at, minlength=1))
    sums = [np.bincount(at, weights=w[place[hit]], minlength=1)[there] for w in weights]
    which = np.searchsorted(first, there, side="right") - 1
    which, *lists = L.listed(which, (there - first[which]).astype(np.uint32), *sums)
    none = pa.nulls(len(which), pa.binary())
    names = ["chunk", "docs", "ids", "n", "known", "base", "score"]
    out = pa.table([runs_.column("chunk").combine_chunks().take(which), lists[0], none, none, *lists[1:]], names=names)
    return pa.concat_tables([out, given.select(names).cast(out.schema)])


def _together(lists: pa.Table) -> pa.Table:
    """Per text of a chunk its key, its token count and its sums."""
    ids, n = L.flat(lists.column("ids"), np.int64), L.flat(lists.column("n"), np.int64)
    given, parts = lists.filter(lists.column("ids").is_valid()), lists.filter(lists.column("ids").is_null())
    docs = L.flat(parts.column("docs"), np.uint32)
    sums = [L.flat(given.column(c), np.float64) + np.bincount(
        docs, weights=L.flat(parts.column(c), np.float64), minlength=len(ids)) for c in ("known", "base", "score")]
    return pa.table({"_row": ids, "n": n, "n_known": np.rint(sums[0]).astype(np.int64), "base": sums[1], "score": sums[2]})


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH,
           context: float = CONTEXT, follow: float = FOLLOW, divergence: float = DIVERGENCE) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words without ASCII white space, A-Z in lower case, and one end per text; null is the empty
    text. All texts are scored, whole; the model learns from those not held out, repeated rows as often
    as they come. `base_score` sums log10((c + 0.1) / (N + 0.1 * (V + 1))). `score` takes each token's
    probability from the longest state that the words before it end in: its discounted share if the token is
    one of the state's own, else what the state leaves, spread as the shorter state has it, down to
    the single tokens. Probabilities of a state sum to 1 over all words and one unknown.

    Contexts of up to `depth` words seen `context` times and words seen `follow` times after them (never less
    than SEEN) are in the model, however rare they are in the corpus; their weights are joined by run.
    With nothing to learn from, every token has probability 1 / (V + 1) with V = 0.
    """
    rows = C.identified(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")), "_key", "_row", "text")
    with C.dropping_shuffles(docs.sparkSession):
        texts = C.staged(_numbered(rows.select(
            "_row", (~held_out(F.col("_key"))).alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
        )), "numbers")
        tree = grow(texts, depth, context, follow, divergence)
        total, distinct, buckets = tree.total, tree.distinct, tree.buckets
        hot = _weights_of(tree.weights.where("bucket < 0").toArrow())
        sent = docs.sparkSession.sparkContext.broadcast((hot, tree.states, tree.weighted))
        work = _weighed(depth, sent, buckets)
        # One part of the texts after the other, so that the runs of only one are on disk.
        parts = SCORED_IN if total > BUCKET else 1
        done = []
        for part in range(parts):
            lists = texts.where(F.pmod(F.shiftright("chunk", 32) + F.shiftright(F.col("chunk").bitwiseAND(0xFFFFFFFF), 1), F.lit(parts)) == part).select(
                "chunk", "rows", "sizes", "words", "codes"
            ).mapInArrow(
                work, "bucket int, chunk bigint, docs binary, code binary, ids binary, n binary, known binary, base binary, score binary"
            )
            sums = lists.groupBy("bucket").cogroup(tree.weights.where("bucket >= 0").groupBy("bucket")).applyInArrow(
                _joined, "chunk bigint, docs binary, ids binary, n binary, known binary, base binary, score binary")
            done.append(C.staged(sums.groupBy("chunk").applyInArrow(
                _together, "_row bigint, n bigint, n_known bigint, base double, score double"), "sums"))
        sent.destroy()
        discard(texts, tree.weights)
    sums = done[0]
    for x in done[1:]:
        sums = sums.unionByName(x)
    done = sums.join(rows.select("_row", "_key"), "_row")
    none = F.col("n") * float(np.log10(SMOOTH) - np.log10(total + SMOOTH * (distinct + 1)))
    return done.select(
        F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), F.col("n").alias("n_tokens"),
        "n_known",
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        *[(F.col(c) + none).alias(f"{c}_score" if c == "base" else c) for c in ("base", "score")],
    )
