"""Tokenizers by name: `fit` learns from a corpus, `transform` encodes a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions import lookup as L, text as T
from ..operators import codes, corpus, encode, merges, repack, training, vocab
from ..session import materialize
from ..sources import saved

# Default special tokens and sizes, by the role they have in a config.
DEFAULT_SPECIALS = {
    "unk_token": "<unk>", "bos_token": "<s>", "eos_token": "</s>", "pad_token": "<pad>",
}
DEFAULT_VOCAB = 50_257
TEXT_COVERAGE, CODE_COVERAGE = 0.9995, 1.0
LINE_VOCAB, LINE_MIN_COUNT = 52_000, 2
LINE_SPECIALS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]


def optional_int(value) -> int | None:
    """A config number; an empty string means none."""
    return None if value in (None, "") else int(value)


@dataclass
class TokenizerConfig:
    name: str
    n_positions: int = 1024
    max_vocab_size: int | None = DEFAULT_VOCAB
    max_examples: int | None = None
    special_tokens: dict[str, str] = field(default_factory=dict)
    input_method: str = ""
    sp_path: str = ""
    tokenizer_files_dir: str = ""
    vocab_file_name: str = ""

    @classmethod
    def from_mapping(cls, config: Mapping, n_positions: int) -> "TokenizerConfig":
        """From the `tokenizer` part of a configuration, a mapping or a row."""
        config = config.asDict(recursive=True) if isinstance(config, Row) else config
        return cls(
            name=config["name"],
            n_positions=n_positions,
            max_vocab_size=optional_int(config.get("max_vocab_size")) or DEFAULT_VOCAB,
            max_examples=optional_int(config.get("max_examples")),
            special_tokens=dict(config.get("special_tokens") or {}),
            input_method=config.get("input_method") or "",
            sp_path=config.get("sp_path") or "",
            tokenizer_files_dir=config.get("tokenizer_files_dir") or "",
            vocab_file_name=config.get("vocab_file_name") or "",
        )

    @property
    def folder(self) -> str:
        """Where the tokenizer is kept; empty when the configuration names no place."""
        return "/".join(part.rstrip("/") for part in (self.tokenizer_files_dir, self.vocab_file_name) if part)

    def special(self, role: str) -> str:
        return self.special_tokens.get(role, DEFAULT_SPECIALS[role])


class Tokenizer:
    """Base: encodes a table with a `text` column into fixed-length arrays."""

    def __init__(self, config: TokenizerConfig, key: str = "doc_id", text: str = "text"):
        self.config, self.key, self.text = config, key, text

    def fit(self, docs: DataFrame) -> "Tokenizer":
        return self

    def ids(self, text: Column) -> Column:
        raise NotImplementedError

    @property
    def pad_id(self) -> int:
        raise NotImplementedError

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def decode(self, ids: Column) -> Column:
        """The text of an array of ids. Padding, start and end marks have none; the unknown mark stays."""
        raise NotImplementedError

    def settings(self) -> dict:
        """What a saved tokenizer needs besides its tables."""
        return {"config": asdict(self.config), "key": self.key, "text": self.text}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The tables to save."""
        return {}

    def restore(self, tables: Mapping[str, DataFrame], settings: Mapping) -> "Tokenizer":
        """Take saved tables in place of learning."""
        return self

    def save(self, spark: SparkSession, path: str) -> int:
        """Write a new version of a folder that `open_tokenizer` reads; its number."""
        return saved.write_version(self.tables(spark), spark, path, type(self).__name__, self.settings())

    def transform(self, docs: DataFrame, mask_labels: bool = False) -> DataFrame:
        """Add input_ids, attention_mask, labels and n_cut."""
        rows = docs.withColumn("_ids", self.ids(F.col(self.text)))
        return encode.pack(rows, "_ids", self.config.n_positions, self.pad_id, mask_labels).drop("_ids")


class CharacterTokenizer(Tokenizer):
    """One token per character; the vocabulary is ranked by frequency."""

    def fit(self, docs: DataFrame) -> "CharacterTokenizer":
        config = self.config
        kept = vocab.cap_documents(
            docs.select(self.key, self.text), config.max_vocab_size, config.max_examples,
            self.key, self.text,
        )
        ranked = vocab.ranked_tokens(kept, vocab.char_column(self.text), self.key)
        specials = list(config.special_tokens.values())
        return self.load(
            materialize(vocab.assign_ids(specials, ranked, config.max_vocab_size), "vocab")
        )

    def load(self, tokens: DataFrame) -> "CharacterTokenizer":
        """Use a vocabulary that exists; marks it lacks are added behind it."""
        marks = [self.config.special(role) for role in DEFAULT_SPECIALS]
        known = {r.token: r.id for r in tokens.where(F.col("token").isin(*marks)).collect()}
        missing = [mark for mark in dict.fromkeys(marks) if mark not in known]
        if missing:
            size = tokens.count()
            added = [(mark, size + i) for i, mark in enumerate(missing)]
            known.update(added)
            table = tokens.sparkSession.createDataFrame(added, "token string, id bigint")
            tokens = materialize(vocab.vocab_with_added(tokens, table), "vocab")
        self._vocab, self._pad = tokens, known[self.config.special("pad_token")]
        return self

    def ids(self, text: Column) -> Column:
        return encode.char_ids(text, self._vocab, self.config.special("unk_token"))

    def decode(self, ids: Column) -> Column:
        rows = L.small_rows(self._vocab.select("token", "id"), L.CODE_POINTS + len(DEFAULT_SPECIALS))
        unknown = self.config.special("unk_token")
        silent = {self.config.special(role) for role in DEFAULT_SPECIALS} - {unknown}
        return encode.joined_tokens(ids, {r.id: "" if r.token in silent else r.token for r in rows}, unknown)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"vocab": self._vocab}

    def restore(self, tables: Mapping[str, DataFrame], settings: Mapping) -> "CharacterTokenizer":
        return self.load(tables["vocab"])

    @property
    def pad_id(self) -> int:
        return self._pad

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return self._vocab


class ByteTokenizer(Tokenizer):
    """One token per UTF-8 byte; nothing to learn."""

    def ids(self, text: Column) -> Column:
        return encode.byte_ids(text)

    def decode(self, ids: Column) -> Column:
        return encode.bytes_from_ids(ids)

    @property
    def pad_id(self) -> int:
        return encode.BYTE_SPECIALS["<pad>"]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return encode.byte_alphabet(spark)


class MergedTokenizer(Tokenizer):
    """Merged vocabulary over words of the text, its bytes or its written codes."""

    form = "text"

    def __init__(self, config: TokenizerConfig, key: str = "doc_id", text: str = "text",
                 dictionary: DataFrame | None = None, phrases: DataFrame | None = None,
                 merges: int | None = None, max_line_bytes: int | None = None,
                 coverage: float | None = None):
        super().__init__(config, key, text)
        self.dictionary, self.phrases, self.merges = dictionary, phrases, merges
        self.max_line_bytes = max_line_bytes
        usual = TEXT_COVERAGE if self.form == "text" else CODE_COVERAGE
        self.coverage = usual if coverage is None else coverage

    def written(self, text: Column) -> Column:
        """The text in the form that is cut into words."""
        if self.form == "bytes":
            return T.latin1_text(text)
        if self.form == "codes":
            return codes.convert_text(text, self.config.input_method, self.dictionary, self.phrases)
        return text

    def training_pieces(self, docs: DataFrame) -> DataFrame:
        rows = corpus.max_examples(docs.select(self.key, self.text), self.config.max_examples, self.key)
        lines = corpus.training_lines(rows, self.text, keep_blank=self.form == "codes")
        written = lines.select(self.written(F.col(self.text)).alias("written"))
        fitting = F.col("written")
        if self.max_line_bytes is not None:
            # Longer lines are left out; a short text can hold none.
            limit = self.max_line_bytes
            short = F.filter(F.split("written", "\n"), lambda line: F.octet_length(line) <= limit)
            fitting = F.when(F.octet_length("written") <= limit, fitting).otherwise(F.array_join(short, "\n"))
        return merges.piece_counts(written, merges.words(fitting), merges.WORD_MARK)

    def fit(self, docs: DataFrame) -> "MergedTokenizer":
        pieces = materialize(self.training_pieces(docs), "piece-counts")
        chars = pieces.select(F.explode(T.char_tokens(F.col("piece"))).alias("token"), "n")
        kept = vocab.covered_chars(
            chars.groupBy("token").agg(F.sum("n").alias("n")), self.coverage
        ).orderBy(F.desc("n"), "token")
        alphabet = [r.token for r in L.small_rows(kept.select("token"), L.CODE_POINTS)]
        user = [t for t in self.config.special_tokens.values()]
        specials = list(dict.fromkeys(["<unk>", "<s>", "</s>", *user]))
        room = self.config.max_vocab_size - len(specials) - len(alphabet)
        wanted = self.merges if self.merges is not None else max(room, 0)
        known = alphabet if self.coverage < 1.0 else None
        model = training.train_merges(pieces, wanted, 1, known)
        return self._take(model, specials, merges.merged_vocab(model, specials, alphabet))

    def _take(self, model: merges.MergeModel, specials: list[str], tokens: list[str]) -> "MergedTokenizer":
        self.model, self.specials, self.tokens = model, specials, tokens
        self.numbers = merges.symbol_numbers(model, tokens, specials)
        return self

    def settings(self) -> dict:
        return {**super().settings(), "specials": self.specials}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        given = {"dictionary": self.dictionary, "phrases": self.phrases}
        return {
            "merges": self.model.table(spark), "vocab": self.vocabulary(spark),
            **{name: table for name, table in given.items() if table is not None},
        }

    def restore(self, tables: Mapping[str, DataFrame], settings: Mapping) -> "MergedTokenizer":
        self.dictionary = tables.get("dictionary", self.dictionary)
        self.phrases = tables.get("phrases", self.phrases)
        rows = L.small_rows(tables["vocab"].select("token", "id"), merges.MOST_TOKENS)
        tokens = [r.token for r in sorted(rows, key=lambda r: r.id)]
        return self._take(merges.MergeModel.from_table(tables["merges"]), settings["specials"], tokens)

    def decode(self, ids: Column) -> Column:
        """Words with one space between them. Texts written in codes come back as codes."""
        silent = set(self.specials) - {"<unk>"}
        names = {i: "" if token in silent else token for i, token in enumerate(self.tokens)}
        return self.spelled(encode.joined_tokens(ids, names, "<unk>"))

    def spelled(self, written: Column) -> Column:
        """The text of units in a row: word marks as spaces, bytes as characters."""
        plain = F.regexp_replace(F.replace(written, F.lit(merges.WORD_MARK), F.lit(" ")), "^ ", "")
        return T.text_of_latin1(plain) if self.form == "bytes" else plain

    def ids(self, text: Column, runs: dict[str, int] | None = None) -> Column:
        """Ids of the text; unknown runs that `runs` knows have its ids."""
        pieces = merges.spaced_words(self.written(text))
        unknown = self.tokens.index("<unk>")
        return merges.merged_ids(pieces, self.model, self.numbers, unknown, merges.WORD_MARK, runs)

    def texts(self, text: Column) -> Column:
        """The same units as texts, unknown runs too."""
        pieces = merges.spaced_words(self.written(text))
        return merges.merged_texts(pieces, self.model, self.numbers, merges.WORD_MARK)

    @property
    def pad_id(self) -> int:
        pad = self.config.special("pad_token")
        return self.tokens.index(pad) if pad in self.tokens else 0

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(t, i) for i, t in enumerate(self.tokens)], "token string, id bigint")


class ByteMergedTokenizer(MergedTokenizer):
    form = "bytes"


class InputMethodTokenizer(MergedTokenizer):
    form = "codes"

    def __init__(self, config: TokenizerConfig, *args, **more):
        super().__init__(config, *args, **more)
        codes.check_method(config.input_method)


class RepackedTokenizer(Tokenizer):
    """Tokens of a fitted merged tokenizer, each written as 1 to 4 bytes by rank. Tokens are
    told by their text, so every run of unknown characters is a token of its own."""

    def __init__(self, config: TokenizerConfig, base: MergedTokenizer | None = None, key: str = "doc_id",
                 text: str = "text"):
        super().__init__(config, key, text)
        if config.input_method:
            codes.check_method(config.input_method)
        if base is not None and base.config.input_method != config.input_method:
            raise ValueError(f"the base is written in {base.config.input_method!r}, not {config.input_method!r}")
        self.base = base

    def fit(self, docs: DataFrame) -> "RepackedTokenizer":
        rows = corpus.max_examples(docs.select(self.key, self.text), self.config.max_examples, self.key)
        rows = corpus.non_empty(rows, self.text)
        tokens = self.base.texts(T.py_strip(F.col(self.text)))
        ranked = vocab.ranked_tokens(rows, tokens, self.key)
        return self.load(materialize(repack.assign_byte_codes(ranked), "remap"))

    def load(self, remap: DataFrame) -> "RepackedTokenizer":
        """Use a table of codes (token, rank, code) that exists."""
        self.remap = remap
        rows = L.small_rows(remap, repack.CODES)
        table = {r.token: list(r.code) for r in rows}
        self.ranks = {r.rank: r.token for r in rows}
        self.unknown = table.pop("<unk>")
        known = {self.base.tokens[i]: i for i in self.base.numbers.values()}
        first = len(self.base.tokens)
        self.runs = {text: first + k for k, text in enumerate(t for t in table if t not in known)}
        self.codes = {known.get(text, self.runs.get(text)): code for text, code in table.items()}
        return self

    def settings(self) -> dict:
        return {**super().settings(), "base": {"kind": type(self.base).__name__, **self.base.settings()}}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"remap": self.remap, **{f"base-{name}": table for name, table in self.base.tables(spark).items()}}

    def restore(self, tables: Mapping[str, DataFrame], settings: Mapping) -> "RepackedTokenizer":
        inner = {name.removeprefix("base-"): table for name, table in tables.items() if name.startswith("base-")}
        self.base = _restored(settings["base"]["kind"], settings["base"], inner)
        return self.load(tables["remap"])

    def decode(self, ids: Column) -> Column:
        """The text of the tokens whose codes are whole; a code that a cut has parted is left out."""
        values = F.transform(F.filter(ids, lambda i: i >= encode.BYTE_OFFSET), lambda i: i - encode.BYTE_OFFSET)
        return self.base.spelled(encode.joined_tokens(repack.ranks_of(values), self.ranks, "<unk>"))

    def ids(self, text: Column) -> Column:
        return repack.repacked_ids(
            self.base.ids(text, self.runs), self.codes, self.unknown, encode.BYTE_OFFSET)

    @property
    def pad_id(self) -> int:
        return encode.BYTE_SPECIALS["<pad>"]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return encode.byte_alphabet(spark)


# Names a configuration may use.
REGISTRY = {
    "CharacterTokenizer": CharacterTokenizer,
    "SubwordBPETokenizer": MergedTokenizer,
    "ByteTokenizer": ByteTokenizer,
    "ByteBPETokenizer": ByteMergedTokenizer,
    "ChineseBPETokenizer": InputMethodTokenizer,
    "RepackagedByteTokenizer": RepackedTokenizer,
}


def tokenizer_from_config(config: Mapping, n_positions: int, spark: SparkSession | None = None, **extra) -> Tokenizer:
    """A tokenizer from the `tokenizer` part of a configuration. `extra` passes the
    dictionary, phrase table, base tokenizer or number of merges. A re-coding
    tokenizer without a base opens the one saved at `sp_path`, for which it needs `spark`."""
    parsed = TokenizerConfig.from_mapping(config, n_positions)
    if parsed.name not in REGISTRY:
        raise ValueError(f"unknown tokenizer: {parsed.name!r}")
    kind = REGISTRY[parsed.name]
    if kind is RepackedTokenizer and "base" not in extra:
        if not parsed.sp_path or spark is None:
            raise ValueError("a re-coding tokenizer needs its base, or sp_path and a session")
        extra["base"] = open_tokenizer(spark, parsed.sp_path)
    return kind(parsed, **extra)


_KINDS = {kind.__name__: kind for kind in REGISTRY.values()}


def _restored(kind: str, settings: Mapping, tables: Mapping[str, DataFrame], n_positions: int | None = None) -> Tokenizer:
    config = TokenizerConfig(**settings["config"])
    config.n_positions = n_positions or config.n_positions
    return _KINDS[kind](config, key=settings["key"], text=settings["text"]).restore(tables, settings)


def open_tokenizer(spark: SparkSession, path: str, n_positions: int | None = None) -> Tokenizer:
    """The newest saved version of a tokenizer. Nothing is learned again."""
    kind, settings, tables = saved.read_version(spark, path)
    return _restored(kind, settings, tables, n_positions)


def prepared(spark: SparkSession, config: Mapping, n_positions: int, docs: DataFrame, **extra) -> Tokenizer:
    """The tokenizer that a configuration keeps in its folder; where nothing is saved there, it is
    learned from `docs` and saved first."""
    made = tokenizer_from_config(config, n_positions, spark, **extra)
    folder = made.config.folder
    if not folder:
        raise ValueError("the configuration names no folder (tokenizer_files_dir)")
    if saved.newest(spark, folder) is None:
        made.fit(docs).save(spark, folder)
    return open_tokenizer(spark, folder, n_positions)


def byte_level_model(docs: DataFrame, text: str = "text", size: int = LINE_VOCAB,
                     min_count: int = LINE_MIN_COUNT, specials: list[str] = LINE_SPECIALS,
                     ) -> tuple[merges.MergeModel, list[str]]:
    """(model, tokens in id order): specials, 256 bytes, then merges of pairs seen at
    least `min_count` times."""
    alphabet = sorted(chr(c) for c in merges.byte_level_table())
    lines = docs.select(F.explode(F.split(F.col(text), r"(?<=\n)")).alias("line"))
    pieces = merges.piece_counts(lines, merges.byte_level_pieces(F.col("line")))
    room = max(size - len(specials) - len(alphabet), 0)
    model = training.train_merges(pieces, room, min_count)
    return model, merges.merged_vocab(model, specials, alphabet, chars_first=True)


def byte_level_ids(text: Column, model: merges.MergeModel, tokens: list[str],
                   specials: list[str] = LINE_SPECIALS) -> Column:
    numbers = merges.symbol_numbers(model, tokens, specials)
    return merges.merged_ids(merges.byte_level_pieces(text), model, numbers, tokens.index("<unk>"))
