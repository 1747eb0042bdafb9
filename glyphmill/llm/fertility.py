"""Quality rules from how public vocabularies split a text."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common as C


@dataclass(frozen=True)
class Band:
    """What a text of one script must keep to. `min_entropy` (bits per token) holds
    from `entropy_from` tokens on: a short text has few tokens to differ in."""

    min_chars: float = 1.1
    max_chars: float = 8.0
    max_bytes: float = 0.25
    min_entropy: float = 3.0
    entropy_from: int = 64
    max_units: float = 1.0


# Characters per token of ordinary prose differ by script, because the vocabularies were
# learned mostly on Latin text. `max_units` bounds byte-level tokens per UTF-8 byte. Those of Latin are from the
# 3,307 documents of sf0.1 with 20 words or more that are labelled good (1.654 to 2.469 characters per token, no byte
# tokens, 4.48 bits or more, 0.395 to 0.553 units) and from noise (random letters 1.53 and 0.66 units, base64 1.20
# and 0.78, hex 1.08 and 0.60). Of the other scripts there are no labelled documents: their limits are as
# first set, but for texts of no named script, which may not be in byte tokens (rare emoji: 0.93) as a whole.
BANDS: Mapping[str, Band] = {
    "latin": Band(1.6, 8.0, 0.1, 4.0, 64, 0.6),
    "greek": Band(0.6, 6.0, 0.4), "cyrillic": Band(0.7, 8.0, 0.3), "hebrew": Band(0.5, 6.0, 0.6),
    "arabic": Band(0.5, 6.0, 0.6), "indic": Band(0.3, 6.0, 0.95), "hangul": Band(0.25, 4.0, 0.95),
    "kana": Band(0.3, 4.0, 0.9), "han": Band(0.25, 4.0, 0.95), "other": Band(0.3, 8.0, 0.85),
}

# First bytes of UTF-8 characters, by script.
LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF],
    "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3], "hebrew": [0xD6, 0xD7], "arabic": [0xD8, 0xD9, 0xDA, 0xDB],
    "indic": [0xE0], "kana": [0xE3], "han": [*range(0xE4, 0xEA)], "hangul": [*range(0xEA, 0xEE)],
}
SCRIPTS = [*LEADS, "other"]

# Repeats are looked for in runs of so many words.
RUN = 8

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "script string, n_tokens bigint, n_bytes bigint, entropy double, n_units bigint, word_bytes bigint"
)


# A task measures about so many bytes of text at a time, with some two hundred bytes of numbers for each word.
STEP_BYTES = 2_000_000


def _pieces(path: str):
    import sentencepiece

    return C.held("fertility", ("pieces", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def _units(path: str, pattern: str):
    import tiktoken

    def read():
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return C.held("fertility", ("units", path, pattern), read)


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def repeated_words(words: C.Words, n: int) -> np.ndarray:
    """Per row, the words in runs of RUN words that are in the row twice or more."""
    starts = np.flatnonzero(words.places + RUN <= words.sizes[words.rows])
    hashes = C.Windows(C.mix(words.codes.astype(np.uint64) + np.uint64(1))).at(starts, RUN)
    keys = hashes ^ C.mix(words.rows[starts].astype(np.uint64) + np.uint64(1))
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = starts[counts[place] > 1]
    open_ = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(open_, again, 1)
    np.add.at(open_, again + RUN, -1)
    return np.bincount(words.rows[np.cumsum(open_)[:-1] > 0], minlength=n)


def repeated_lines(texts: pa.Array, n: int) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    lines = pc.split_pattern(texts, "\n")
    coded = lines.flatten().dictionary_encode()
    rows = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy())
    full = np.fromiter(
        (bool(x.strip()) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()), bool,
        len(coded.dictionary),
    )
    codes = coded.indices.to_numpy().astype(np.int64)
    rows, codes = rows[full[codes]], codes[full[codes]]
    firsts = np.unique(rows * (len(full) + 1) + codes) // (len(full) + 1)
    return np.bincount(rows, minlength=n) - np.bincount(firsts, minlength=n)


def scripts(texts: pa.Array) -> np.ndarray:
    """Per row, the number in SCRIPTS of the script with most letters."""
    table = np.full(256, -1)
    for number, leads in enumerate(LEADS.values()):
        table[leads] = number
    found = []
    for text in texts.cast(pa.large_binary()).to_pylist():
        kinds = table[np.frombuffer(text, np.uint8)]
        counts = np.bincount(kinds[kinds >= 0], minlength=1)
        found.append(counts.argmax() if counts.any() else len(LEADS))
    return np.array(found, np.int64)


def _token_measures(words: C.Words, n: int, piece_path: str, unit_path: str, pattern: str):
    """Tokens, byte tokens and token entropy by the piece vocabulary; byte-level tokens.
    Every distinct word is encoded once, as after a space."""
    model = _pieces(piece_path)
    texts = [w.decode("utf-8", "replace") for w in words.distinct]
    ids = model.encode(texts, num_threads=1) if texts else []
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    total = model.get_piece_size()
    is_byte = np.fromiter((model.is_byte(i) for i in range(total)), np.int64, total)
    word_of = np.repeat(np.arange(len(ids)), sizes)
    byte_tokens = np.bincount(word_of, weights=is_byte[flat], minlength=len(ids))
    # One by one: a batch of such short texts spends its time on handing them to threads.
    split = _units(unit_path, pattern).encode_ordinary
    unit_counts = np.fromiter((len(split(" " + t)) for t in texts), np.int64, len(texts))

    each = sizes[words.codes]
    ends = np.cumsum(each)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[words.codes] - ends + each, each)
    keys, counts = np.unique(np.repeat(words.rows, each) * total + flat[place], return_counts=True)
    n_tokens = _per_row(each, words.rows, n)
    spread = np.bincount(keys // total, weights=counts * np.log2(counts), minlength=n)
    least = np.maximum(n_tokens, 1)
    entropy = np.maximum(np.log2(least) - spread / least, 0.0)
    lengths = np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))
    return (
        n_tokens, _per_row(byte_tokens[words.codes], words.rows, n), entropy,
        _per_row(unit_counts[words.codes], words.rows, n), _per_row(lengths[words.codes], words.rows, n),
    )


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
            piece_path: str | None = None, unit_path: str | None = None,
            pattern: str | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all) and those of SCHEMA, which replace columns of their names.

    Words are runs without ASCII white space; a null text has none and counts 0
    everywhere. A text is split whole, however long. The tokens of a text are those of
    its words, each encoded as after a space; white space is not measured. Paths and
    pattern default to the installed public vocabularies. Nothing is shuffled: rows,
    repeated or not, are measured where they are.
    """
    import public_tokenizers as P

    piece_path = piece_path or P.path("piece_bpe_32k.model")
    unit_path, pattern = unit_path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN
    added = [f.split()[0] for f in SCHEMA.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    text_name = C.free_name(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(text_name))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, text_name, STEP_BYTES):
            texts = pc.fill_null(batch.column(text_name).cast(pa.large_string()), "")
            n, words = len(texts), C.Words(texts)
            spaces = pc.count_substring_regex(texts, r"[\x20\x09-\x0D]").to_numpy()
            tokens = _token_measures(words, n, piece_path, unit_path, pattern)
            columns = [
                words.sizes, pc.utf8_length(texts).to_numpy().astype(np.int64) - spaces,
                pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(),
                repeated_lines(texts, n), repeated_words(words, n),
                np.array(SCRIPTS, object)[scripts(texts)], *tokens,
            ]
            arrays = [pa.array(c) if c.dtype == object or c.dtype.kind == "f" else pa.array(c, pa.int64())
                      for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*kept, *added])

    return source.mapInArrow(lambda batches: C.released(measured(batches)), f"{fields}, {SCHEMA}")


def judged(measures: DataFrame, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """`measure`'s rows with base_failed, chars_per_token, byte_share, in_band and kept.

    A text without words fails the base rule (fewer than 20 words). Limits are inclusive.
    """
    tokens = F.greatest("n_tokens", F.lit(1))
    rows = measures.withColumns({
        "base_failed": (F.col("n_words") < 20)
        | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "chars_per_token": F.col("word_chars") / tokens, "byte_share": F.col("n_bytes") / tokens,
        "units_per_byte": F.col("n_units") / F.greatest("word_bytes", F.lit(1)),
    })
    ok = None
    for script, band in bands.items():
        holds = (
            F.col("chars_per_token").between(band.min_chars, band.max_chars)
            & (F.col("byte_share") <= band.max_bytes) & (F.col("units_per_byte") <= band.max_units)
            & ((F.col("n_tokens") < band.entropy_from) | (F.col("entropy") >= band.min_entropy))
        )
        ok = F.when(F.col("script") == script, holds) if ok is None else ok.when(F.col("script") == script, holds)
    rows = rows.withColumn("in_band", ok.otherwise(F.lit(True)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
