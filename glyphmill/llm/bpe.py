"""Encode and decode by ranked merges, with a segment tree over adjacent pairs."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.merges import byte_level_table
from . import common as C

# A task forgets the words it has encoded when it holds more than this many.
_MEMO_WORDS = 500_000
# Rows that a task works on at a time: ids and decoded text are several times the text.
_ROWS = 256
_NEVER = 1 << 62


def merge_by_tree(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Join pairs until none can be: always the lowest rank, of equal ones the leftmost.

    A leaf stands for the pair that starts at its place and holds rank and place in one
    number; a node holds the least of its children, so the root is the next merge. A
    merge changes three leaves: its own, the one before, and the one it swallows.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NEVER] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found:
            tree[size + i] = found[0] * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = [*symbols]

    def put(place: int, value: int) -> None:
        node = size + place
        if tree[node] == value:
            return
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] < _NEVER:
        i = tree[1] % n
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = get((symbols[i], symbols[k]))
            put(i, found[0] * n + i if found else _NEVER)
        else:
            put(i, _NEVER)
        if j < n - 1:
            put(j, _NEVER)
        h = before[i]
        if h >= 0:
            found = get((symbols[h], symbols[i]))
            put(h, found[0] * n + h if found else _NEVER)
    return [s for s in symbols if s >= 0]


class WordCoder:
    """A vocabulary file of lower-cased words with an end-of-word mark."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.added = added
        self.ranks = {
            (vocab[a], vocab[b]): (rank, vocab[a + b])
            for rank, (a, b) in enumerate(map(tuple, model["merges"]))
        }
        self.bytes = [chr(c) for c in byte_level_table()]
        self.vocab = vocab
        rule = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The file's rule is for a library whose \s is Unicode's white space.
        self.pieces = regex.compile(rule.replace(r"\s", r"\p{White_Space}")).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(added))) + ")").split
        self.memo: dict[str, list[int]] = {}
        self.table: pa.Array | None = None

    def piece(self, text: str) -> list[int]:
        chars = [self.bytes[b] for b in text.encode()]
        chars[-1] += self.end
        return merge_by_tree([self.vocab[c] for c in chars], self.ranks)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for part in self.specials(text):
            if part in self.added:
                out.append(self.added[part])
                continue
            # Lower-casing is by character there: a last sigma is like any other.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            # No piece goes over white space, so what stands between is encoded once. Other white
            # space than these two stays inside and is in no piece.
            for word in part.replace("\n", " ").split(" "):
                ids = memo.get(word)
                if ids is None:
                    if len(memo) > _MEMO_WORDS:
                        memo.clear()
                    ids = memo[word] = [i for piece in self.pieces(word) for i in self.piece(piece)]
                out += ids
        return out

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of a column of id lists; a null list is empty."""
        if self.table is None:
            self.table = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_string())
        flat, sizes = ids.flatten(), pc.fill_null(ids.value_lengths(), 0).to_numpy()
        numbers = flat.to_numpy(zero_copy_only=False)
        known = (numbers >= 0) & (numbers < len(self.table))
        tokens = self.table.take(pa.array(np.where(known, numbers, 0)))
        known &= tokens.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(ids)), sizes)[known]
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(ids)))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.filter(pa.array(known)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def coder(path: str) -> WordCoder:
    return C.held("bpe", path, lambda: WordCoder(path))


def vocabulary_path() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def _mapped(docs: DataFrame, column: str, work, out: str, kind: str) -> DataFrame:
    """All columns of `docs` and `out` = work(column as an Arrow array), in place of one of that name."""
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    value = C.free_name(docs, "_value")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias(value))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], work(part.column(value))], names=[*kept, out])

    return source.mapInArrow(lambda batches: C.released(mapped(batches)), f"{fields}`{out}` {kind}")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """All columns and the token ids of each whole text; a null or empty text has none.

    Nothing is shuffled; rows, repeated or not, are encoded where they are. An
    existing column named `out` is replaced.
    """
    path = path or vocabulary_path()
    return _mapped(docs, text, lambda texts: pa.array(
        [coder(path).encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32())), out, "array<int>")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """All columns and the text of each array of ids: the tokens' texts with a space
    between, special ones included, ids outside the vocabulary left out; null is empty."""
    path = path or vocabulary_path()
    return _mapped(rows, ids, lambda lists: coder(path).decode(lists), out, "string")
